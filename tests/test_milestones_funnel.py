import json
import random

from helpers import at, day, records
from pyspark.sql import functions as F

from conversion_engine.operators import funnel, identity, milestones
from conversion_engine.sources.logs import normalize_events
from conversion_engine.sources.schemas import SCHEMAS

FLAGS = list(milestones.PROFILE_FLAGS)


def changes_by_hand(rows):
    """Accumulate day by day and keep days on which the known flags changed."""
    out = []
    for profile in {r[0] for r in rows}:
        state, previous = [None] * 4, None
        for d in sorted({r[1] for r in rows if r[0] == profile}):
            for r in rows:
                if r[0] == profile and r[1] == d:
                    state = [b if a is None else a if b is None else max(a, b) for a, b in zip(state, r[2:])]
            current = None if None in state else tuple(state)
            if current is not None and current != previous and sum(current) > 0:
                out.append((profile, d, *current, int(sum(current) == 4)))
            previous = current
    return sorted(out)


def changes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMAS["profile_attributes"])
    got = milestones.change_points(df).select("profile_id", "event_date", *FLAGS, "all_attributes")
    return sorted(tuple(r) for r in got.collect())


def test_change_points_by_example(spark):
    rows = [(1, day(1), 0, 0, 0, 0), (1, day(2), 1, 0, 0, 0), (1, day(2), 0, 1, 0, 0), (1, day(3), 0, 1, 0, 0),
            (1, day(4), 0, 0, 1, 1), (1, day(5), 1, 1, 1, 1), (2, day(1), 0, 0, 0, 0), (3, day(1), 1, 0, 0, 0)]
    assert changes(spark, rows) == [(1, day(2), 1, 1, 0, 0, 0), (1, day(4), 1, 1, 1, 1, 1), (3, day(1), 1, 0, 0, 0, 0)]


def test_change_points_agree_with_accumulation(spark):
    rng = random.Random(11)
    rows = [(p, day(rng.randint(1, 9)), *[rng.choice([0, 0, 1, None]) for _ in FLAGS]) for p in range(40) for _ in range(rng.randint(1, 7))]
    assert changes(spark, rows) == changes_by_hand(rows)


def test_activity_counts_distinct_instants_in_the_window(spark):
    def row(device, n, hour=12, name="OPEN"):
        return {"name": name, "timestamp_iso": at(n, hour).isoformat() + "Z", "user_data_idfv": device}

    log = spark.createDataFrame(
        [row("d", 3), row("d", 3), row("d", 3, 13), row("d", 4), row("d", 2), row("d", 31), row("d", 32), row("d", 5, name="LOGIN"),
         row(identity.ZERO_DEVICE, 3)], SCHEMAS["install_log"])
    cohort = spark.createDataFrame([("d", day(3)), ("quiet", day(3))], "device_id string, install_date date")
    days = milestones.activity_days(log, ["OPEN"], day(1), day(60))
    got = records(milestones.activity_summary(days, cohort, ["OPEN"]).select("device_id", "install_date", "OPEN.*"))
    assert got == [{"device_id": "d", "install_date": day(3), "first_date": day(3), "days_to_first": 0, "last_date": day(31),
                    "days_to_last": 28, "actions": 4, "active_days": 3, "actions_per_active_day": 4 / 3}]


def test_two_updates_in_a_window_stay_one_row(spark):
    rows = [(1, day(4), 1, 0, 0, 0), (1, day(6), 0, 1, 0, 0), (1, day(40), 1, 1, 1, 1)]
    points = milestones.change_points(spark.createDataFrame(rows, SCHEMAS["profile_attributes"]))
    social = spark.createDataFrame([(1, day(5), True), (1, day(5), True), (2, day(5), True), (1, day(2), True)],
                                   "id_profile bigint, created_at date, on boolean")
    labels = milestones.flag_events(social, "id_profile", "created_at", F.col("on"), F.lit("Y"), day(1), day(50))
    days = milestones.milestone_days(points, labels, labels)
    keys = spark.createDataFrame([(1, day(3)), (1, day(6)), (3, day(3))], "profile_id bigint, install_date date")
    got = {r.install_date: r for r in milestones.milestone_summary(days, keys).collect()}
    assert set(got) == {day(3), day(6)}
    assert (got[day(3)].profile_info_date, got[day(3)].days_to_first_profile_info, got[day(3)].bio_flag) == (day(4), 1, 1)
    assert (got[day(3)].social_member_yn, got[day(3)].days_to_first_social_toggle_on) == ("Y", 2)
    assert (got[day(6)].profile_info_date, got[day(6)].social_member_yn) == (day(6), None)


# --- funnels ---------------------------------------------------------------


def event(n, name="x", profile="7", user="u", platform="iOS", version="1.0", **params):
    return (day(n), name, platform, profile, user, json.dumps(params), json.dumps({}),
            json.dumps({} if version is None else {"version": version}))


def search(n, profile="7", user="u", country="France", **params):
    return event(n, profile=profile, user=user, action="Search Submitted", destination_country=country, **params)


def normalized(spark, rows):
    return normalize_events(spark.createDataFrame(rows, SCHEMAS["event_log"]), day(1), day(60))


def daily(spark, rows, *names):
    events = normalized(spark, rows)
    specs = funnel.count_specs()
    return funnel.daily_rollup(events, [specs[n] for n in names], identity.user_identity_map(events))


def test_unreleased_foreign_and_undated_events_are_left_out(spark):
    rows = [event(1), event(1, platform="ANDROID"), event(1, platform="web"), event(1, version="1-Staging"),
            event(1, version=None), event(61)]
    assert normalized(spark, rows).count() == 2


def searches(spark, rows, homes):
    events = normalized(spark, rows)

    def enrich(df):
        at_home = df.join(homes, "profile_id", "left")
        region = F.when(F.lower("destination_country").isin("france", "spain"), "Europe").when(
            F.col("destination_country") == "Peru", "America")
        return at_home.withColumn("copies", F.lit(1)).withColumn(
            "trip", funnel.trip_type("destination_country", region, "home_country", "home_region"))

    return funnel.daily_rollup(events, [], identity.user_identity_map(events), funnel.search_spec(), enrich)


def test_identical_searches_count_once_and_trips_are_named(spark):
    homes = spark.createDataFrame([("7", "FRANCE", "europe")], "profile_id string, home_country string, home_region string")
    rows = [search(1, lead_time="7", number_guests=2, arrival_date="2024-02-01", departure_date="2024-02-04"),
            search(1, lead_time="7", number_guests=2, arrival_date="2024-02-01", departure_date="2024-02-04"),
            # Same search, logged out: the user key leads to the same profile, so it is the same search.
            search(1, profile=None, lead_time="7", number_guests=2, arrival_date="2024-02-01", departure_date="2024-02-04"),
            search(1, country="spain", lead_time="abc", number_guests=1), search(1, country="Peru", lead_time="3"),
            search(1, country="Atlantis", lead_time="3"), search(1, country=None), event(1, action="search submitted")]
    got = searches(spark, rows, homes).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.searches_submitted, r.search_domestic_trip, r.search_short_haul_trip, r.search_long_haul_trip) == (4, 1, 1, 1)
    assert abs(r.search_avg_lead_time - 13 / 3) < 1e-9 and r.search_avg_los == 3 and r.search_avg_pax == 1.5


def test_views_and_null_categories(spark):
    rows = [event(1, "VIEW_ITEM", item_category="Hostel", position="3"), event(1, "view_item", item_category="hotel", position="x"),
            event(1, "view_item", position=None), event(1, "view_items", item_category="Hostel")]
    r = daily(spark, rows, "property_views").first()
    assert (r.property_page_views, r.hostels_viewed, r.non_hostels_viewed, r.viewed_property_avg_position) == (3, 1, 1, 3.0)


def test_actions_count_days_and_letter_case_leaves_zero_flags(spark):
    def act(n, label):
        return event(n, "Property_Details_Page_Event", page_type="Property Details", action=label)

    rows = [act(3, "Map View Clicked"), act(3, "Map View Clicked"), act(4, "Map View Clicked"), act(5, "View Main Reviews Clicked"),
            act(5, "View All Reviews Clicked"), act(6, "map view CLICKED"), act(7, "Something else")]
    days = daily(spark, rows, "property_actions").withColumn("profile_id", F.col("profile_id").cast("bigint"))
    assert days.count() == 4
    keys = spark.createDataFrame([(7, day(3)), (7, day(6))], "profile_id bigint, install_date date")
    got = {r.install_date: r for r in funnel.window_rollup(keys, days, actions=True).collect()}
    first = got[day(3)]
    assert (first.property_page_map_clicks, first.first_prop_map_view_post_install_days, first.propt_reviews_clicks,
            first.first_propt_reviews_click_days, first.add_to_wish_list_clicks) == (2, 0, 1, 2, 0)
    assert (got[day(6)].property_page_map_clicks, got[day(6)].first_prop_map_view_post_install_date) == (0, None)


def test_checkout_filter_ignores_case_but_steps_do_not(spark):
    rows = [event(1, "Begin_Checkout", checkout_room_types="Dorm"), event(1, "begin_checkout", checkout_room_types="4 DORM", item_category="Hotel"),
            event(1, "x", action="Checkout Step Viewed", step_name="email"), event(1, "Checkout_Confirm_Clicked"),
            event(1, "x", step_name="email")]
    r = daily(spark, rows, "checkout_starts", "checkout_steps").first()
    assert r.checkout_starts == 2
    assert (r.checkout_dorms_selected_count, r.checkout_privates_selected_count, r.checkout_non_hostels_selected_count,
            r.started_email_step_count, r.checkout_confirm_clicked_count) == (1, 0, 1, 1, 1)


def test_one_pass_keeps_absent_funnels_null(spark):
    rows = [event(3, "view_item", item_category="Hotel"),
            event(4, "Homepage_Event", page_type="Homepage", action="Home Panel Clicked", panel_clicked="SEARCHES 1"),
            event(4, "Homepage_Event", page_type="Homepage", action="Home Panel Clicked", panel_clicked="Deals")]
    days = daily(spark, rows, "property_views", "recent_search", "linkups").withColumn("profile_id", F.col("profile_id").cast("bigint"))
    keys = spark.createDataFrame([(7, day(3)), (7, day(4)), (8, day(3))], "profile_id bigint, install_date date")
    specs = [funnel.WINDOW_SPECS[n] for n in ("property_views", "recent_search", "linkups")]
    got = {r.install_date: r for r in funnel.window_rollup(keys, days, specs).collect()}
    assert (got[day(3)].days0to28_property_views, got[day(3)].day0_property_views, got[day(3)].share_hostels_viewed) == (1, 1, 0.0)
    assert (got[day(4)].days0to28_property_views, got[day(4)].share_hostels_viewed) == (None, None)
    assert got[day(3)].days_to_first_recent_search_days == 1 and got[day(3)].linkups_view_propt_page is None


def test_day_average_is_averaged_over_days(spark):
    rows = [event(3, "view_item", position="1"), event(3, "view_item", position="3"), event(4, "view_item", position="8")]
    days = daily(spark, rows, "property_views").withColumn("profile_id", F.col("profile_id").cast("bigint"))
    keys = spark.createDataFrame([(7, day(3))], "profile_id bigint, install_date date")
    assert funnel.window_rollup(keys, days, [funnel.WINDOW_SPECS["property_views"]]).first().viewed_property_avg_position == 5.0


def test_copies_scale_sums_only(spark):
    days = spark.createDataFrame([(day(3), 7, 2, 1, 1, 4.0)],
                                 "event_date date, profile_id bigint, property_page_views bigint, hostels_viewed bigint, "
                                 "non_hostels_viewed bigint, viewed_property_avg_position double")
    keys = spark.createDataFrame([(7, day(3), 3)], "profile_id bigint, install_date date, devices bigint")
    r = funnel.window_rollup(keys, days, [funnel.WINDOW_SPECS["property_views"]], copies="devices").first()
    assert (r.days0to28_property_views, r.hostels_viewed, r.share_hostels_viewed, r.viewed_property_avg_position) == (6, 3, 0.5, 4.0)


def test_sort_key_of_funnel_is_unique(spark):
    rows = [event(1, "view_item"), event(1, "view_item", profile=None), event(2, "view_item", profile=None, user="stranger")]
    days = daily(spark, rows, "property_views")
    assert sorted((r.event_date, r.profile_id, r.property_page_views) for r in days.collect() if r.profile_id) == [(day(1), "7", 2)]
    assert days.where("profile_id is null").count() == 1
