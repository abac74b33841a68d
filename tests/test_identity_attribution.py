from helpers import at, records
from pyspark.sql import functions as F

from conversion_engine.operators import attribution, identity
from conversion_engine.operators.attribution import OwnedChannels


def test_device_key_takes_the_first_known_id(spark):
    df = spark.createDataFrame([(None, "b", "c"), ("a", "b", None), (None, None, None)], "x string, y string, z string")
    assert [r[0] for r in df.select(identity.device_key("x", "y", "z")).collect()] == ["b", "a", None]


def test_user_key_needs_both_session_parts(spark):
    df = spark.createDataFrame(
        [(None, None, "s", "f", "p", "u"), (None, None, "s", None, "p", "u"), (None, None, None, "f", None, "u"),
         ("a", "b", "s", "f", "p", "u"), (None, "b", "s", "f", "p", "u")],
        "anonymous_id string, user_pseudo_id string, ga_session string, first_open_time string, profile_id string, account_id string")
    assert [r[0] for r in df.select(identity.event_user_key()).collect()] == ["sf", "p", "u", "a", "b"]


def test_first_touch_skips_nulls_per_attribute_and_breaks_ties(spark):
    log = spark.createDataFrame(
        [("d", at(2), None, "x"), ("d", at(3), "late", None), ("d", at(4), "later", "y"),
         ("t", at(1), "b", None), ("t", at(1), "a", None)], "device string, ts timestamp_ntz, campaign string, brand string")
    got = records(attribution.first_touch(log, "device", "ts", ["campaign", "brand"]), "device_id")
    assert got == [{"device_id": "d", "campaign": "late", "brand": "x"}, {"device_id": "t", "campaign": "a", "brand": None}]


def test_identity_map_keeps_one_valid_id(spark):
    log = spark.createDataFrame([("d", "1000001"), ("d", "1000002"), ("d", "undefined"), ("d", "99999"), ("e", None),
                                 ("f", "undefined"), ("g", "abcdefg")], "device string, id string")
    got = {r.device_id: r.profile_id for r in identity.identity_map(log, "device", "id").collect()}
    assert got == {"d": 1000002, "g": None}


def test_user_map_counts_distinct_sessions(spark):
    rows = [("u", "p1", "s1"), ("u", "p1", "s1"), ("u", "p2", "s1"), ("u", "p2", "s2"),
            ("tie", "p1", "s1"), ("tie", "p2", "s2"), ("null", "p9", None), ("out", None, "s1")]
    events = spark.createDataFrame(rows, "user_key string, profile_id string, session_key string")
    got = {r.user_key: (r.profile_id, r.sessions) for r in identity.user_identity_map(events).collect()}
    assert got == {"u": ("p2", 2), "tie": ("p2", 1), "null": ("p9", 0)}


def test_stitching_fills_only_missing_profiles(spark):
    events = spark.createDataFrame([(1, "u", None), (2, "u", "own"), (3, "x", None), (4, None, None)],
                                   "i int, user_key string, profile_id string")
    users = spark.createDataFrame([("u", "mapped"), (None, "never")], "user_key string, profile_id string")
    got = {r.i: r.profile_id for r in identity.resolve_identity(events, users, ["i"]).collect()}
    assert got == {1: "mapped", 2: "own", 3: None, 4: None}


def test_owner_limit(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None), ("d", None), ("d", 5)], "d string, c int")
    one = {r.d: r.owners for r in identity.single_owner_devices(df, "d", "c").collect()}
    assert one == {"a": 1, "c": 0, "d": 1}
    two = {r.d: r.owners for r in identity.single_owner_devices(df, "d", "c", 2).collect()}
    assert two == {"a": 1, "b": 2, "c": 0, "d": 1}


OWNED = OwnedChannels(prefixes={"Site": "Our Site", "Test": "Trial"}, exact={"Site": ("Blog - organic links",)})
# partner, campaign, channel, feature -> detail, source
CASES = [
    (("Google AdWords", "x_RTG", None, None), ("Google - Retargeting", "Google - Retargeting")),
    (("Google AdWords", "rtg", None, None), ("Google - Prospecting", "Google - Prospecting")),
    (("Google AdWords", "summer", None, None), ("Google - Prospecting", "Google - Prospecting")),
    (("Google AdWords", None, None, None), ("Unknown", "Unknown")),
    (("Apple Search Ads", "My BRAND broad", None, None), ("ASA - Brand", "ASA - Brand")),
    (("Apple Search Ads", "broad", None, None), ("ASA - Broad", "ASA - Broad")),
    (("Apple Search Ads", "competitors", None, None), ("ASA - Competitors", "ASA - Competitors")),
    (("Apple Search Ads", "generics", None, None), ("ASA - Generics", "ASA - Generics")),
    (("Apple Search Ads", None, None, None), ("ASA - Other", "ASA - Other")),
    (("UNDISCLOSED", None, None, "paid advertising"), ("Facebook - paid advertising", "Facebook")),
    (("undisclosed", "c", None, None), ("Other", "Facebook")),
    (("TikTok", None, None, "undisclosed"), ("TikTok - paid advertising", "TikTok")),
    (("Push Notifications", None, None, "paid advertising"), ("Other", "Other")),
    ((None, "camp", "Affiliates", None), ("camp", "Other")),
    ((None, None, "newsletter", None), ("CRM / Newsletter", "CRM / Newsletter")),
    ((None, None, "CRM spring", "email"), ("CRM / Newsletter", "CRM / Newsletter")),
    ((None, None, None, "email"), ("CRM / Newsletter", "CRM / Newsletter")),
    ((None, None, "x", "email"), ("Other", "Other")),
    ((None, None, "Our Site", "journeys"), ("Our Site - journeys", "Site")),
    ((None, None, "Blog", "organic links"), ("Blog - organic links", "Site")),
    ((None, None, "Trial", "marketing"), ("Trial - marketing", "Test")),
    ((None, None, None, "marketing"), ("Other - marketing", "Other")),
    ((None, None, None, None), ("Unknown", "Unknown")),
    (("InMobi", None, None, None), ("Unknown", "InMobi / Flymobi")),
    (("Someone", "c", "x", None), ("Other", "Someone")),
]


def test_channel_rules_in_order(spark):
    df = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(CASES)],
                               "i int, partner string, campaign string, channel string, feature string")
    named = attribution.attribute_channels(df.withColumn("ad_partner", attribution.ad_partner("partner")), OWNED)
    got = {r.i: (r.install_source_detail, r.install_source) for r in named.collect()}
    for i, (given, expected) in enumerate(CASES):
        assert got[i] == expected, given


def test_missing_partner_decides_when_it_is_first(spark):
    # The replacement is made per row, so the earliest row always has a partner.
    log = spark.createDataFrame([("d", at(1), None), ("d", at(2), "InMobi")], "device_id string, ts timestamp_ntz, p string")
    got = attribution.first_touch(log, "device_id", "ts", {"ad_partner": attribution.ad_partner("p")}).first()
    assert got.ad_partner == "Unpopulated"


def test_geography(spark):
    countries = spark.createDataFrame([("FR", "France", 1), ("GB", "United Kingdom", 1), ("XX", "Nowhere", None)],
                                      "countryiso2 string, country string, id_subcontinent int")
    regions = spark.createDataFrame([(1, "Western Europe")], "id_subcontinent int, subcontinent string")
    df = spark.createDataFrame([("FR",), ("GB",), ("XX",), ("??",), (None,)], "code string")
    got = {r.code: (r.ip_country, r.ip_region) for r in attribution.enrich_geo(df, "code", countries, regions).collect()}
    assert got == {"FR": ("France", "Western Europe"), "GB": ("UK", "UK"), "XX": ("Nowhere", None),
                   "??": (None, None), None: (None, None)}


def test_rule_without_default_is_null(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    assert [r.x for r in attribution.apply_rules(df, "x", [(F.col("n") == 1, "one")]).collect()] == ["one", None]
