"""Where an install came from: first-touch values, channel rules, geography."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conversion_engine.functions.semantics import ColumnLike, as_col, like_any

Rule = tuple[Column, Column | str]


def first_touch(log: DataFrame, key: ColumnLike, ts: ColumnLike, attrs: Mapping[str, ColumnLike] | Iterable[str],
                key_name: str = "device_id") -> DataFrame:
    """The earliest known value of every attribute, one row per key.

    Each attribute is decided on its own: rows where it is NULL do not count.
    Equal times are decided by the smaller value. This is one grouped
    aggregation, so a key with very many rows is reduced before the shuffle,
    which a window over the key could not do.
    """
    named = dict(attrs) if isinstance(attrs, Mapping) else {a: a for a in attrs}
    rows = log.select(as_col(key).alias(key_name), as_col(ts).alias("__ts"),
                      *[as_col(c).alias(n) for n, c in named.items()])
    earliest = [
        F.min(F.when(F.col(n).isNotNull(), F.struct(F.col("__ts"), F.col(n).alias("v")))).getField("v").alias(n)
        for n in named
    ]
    return rows.groupBy(key_name).agg(*earliest)


def rule_chain(rules: Iterable[Rule], default: Column | str | None = None) -> Column:
    """The value of the first rule that holds; an unknown condition does not hold."""
    def value(v):
        return v if isinstance(v, Column) else F.lit(v)

    chain = None
    for condition, result in rules:
        chain = F.when(condition, value(result)) if chain is None else chain.when(condition, value(result))
    if chain is None:
        return value(default)
    return chain if default is None else chain.otherwise(value(default))


def apply_rules(df: DataFrame, out: str, rules: Iterable[Rule], default: Column | str | None = None) -> DataFrame:
    return df.withColumn(out, rule_chain(rules, default))


# Partner names and labels of the install log.
PARTNER_MISSING = "Unpopulated"
PARTNER_HIDDEN = "undisclosed"
PARTNER_HIDDEN_OWNER = "Facebook"
PARTNER_SEARCH_ADS = "Google AdWords"
PARTNER_STORE_ADS = "Apple Search Ads"
PARTNER_PUSH = "Push Notifications"
STORE_ADS_THEMES = {"brand": "ASA - Brand", "broad": "ASA - Broad",
                    "competitors": "ASA - Competitors", "generics": "ASA - Generics"}
PAID_FEATURES = ("paid advertising", "undisclosed")
CRM_CHANNELS = ("newsletter", "CRM%")
ORGANIC_FEATURES = ("marketing", "organic links", "Social Media", "journeys")


@dataclass(frozen=True)
class OwnedChannels:
    """The owner's own marketing channels, which differ from company to company.

    Both maps go from an output label to how its ``install_source_detail`` looks.
    """

    prefixes: Mapping[str, str] = field(default_factory=dict)
    exact: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def ad_partner(raw: ColumnLike) -> Column:
    """Partner name with missing and hidden names replaced."""
    raw = as_col(raw)
    named = F.when(F.lower(raw) == PARTNER_HIDDEN, F.lit(PARTNER_HIDDEN_OWNER)).otherwise(raw)
    return F.coalesce(named, F.lit(PARTNER_MISSING))


def source_detail_rules(partner: ColumnLike = "ad_partner", campaign: ColumnLike = "campaign",
                        channel: ColumnLike = "channel", feature: ColumnLike = "feature") -> list[Rule]:
    """Ordered rules for the detailed install source; the default is 'Other'."""
    partner, campaign, channel, feature = map(as_col, (partner, campaign, channel, feature))
    search, store = partner == PARTNER_SEARCH_ADS, partner == PARTNER_STORE_ADS
    # One wildcard character stands before "rtg", as in the source data's pattern.
    retargeted = campaign.ilike("%_rtg")
    rules: list[Rule] = [
        (search & retargeted, "Google - Retargeting"),
        (search & ~retargeted, "Google - Prospecting"),
    ]
    rules += [(store & campaign.ilike(f"%{theme}%"), label) for theme, label in STORE_ADS_THEMES.items()]
    rules += [
        (store, "ASA - Other"),
        (feature.isin(*PAID_FEATURES) & (partner != PARTNER_PUSH),
         F.concat(partner, F.lit(" - paid advertising"))),
        (channel == "Affiliates", campaign),
        (like_any(channel, CRM_CHANNELS) | ((feature == "email") & channel.isNull()), "CRM / Newsletter"),
        (feature.isin(*ORGANIC_FEATURES),
         F.concat(F.coalesce(channel, F.lit("Other")), F.lit(" - "), feature)),
        (campaign.isNull() & channel.isNull() & feature.isNull(), "Unknown"),
    ]
    return rules


def source_rules(owned: OwnedChannels = OwnedChannels(), partner: ColumnLike = "ad_partner",
                 detail: ColumnLike = "install_source_detail") -> list[Rule]:
    """Ordered rules for the install source, reading the detail; the default is 'Other'."""
    partner, detail = as_col(partner), as_col(detail)
    starts = dict(owned.prefixes)

    def owned_rule(label: str) -> list[Rule]:
        tests = []
        if label in starts:
            tests.append(detail.like(starts[label] + "%"))
        if owned.exact.get(label):
            tests.append(detail.isin(*owned.exact[label]))
        return [(tests[0] if len(tests) == 1 else tests[0] | tests[1], label)] if tests else []

    labels = list(dict.fromkeys([*owned.prefixes, *owned.exact]))
    rules: list[Rule] = [
        (partner.isin("InMobi", "Flymobi"), "InMobi / Flymobi"),
        (detail.like("Facebook%"), "Facebook"),
    ]
    for label in labels[:1]:
        rules += owned_rule(label)
    rules.append((detail.like("TikTok%"), "TikTok"))
    for label in labels[1:]:
        rules += owned_rule(label)
    rules += [
        (partner.isin(PARTNER_STORE_ADS, PARTNER_SEARCH_ADS), detail),
        (partner.isNotNull() & ~partner.isin(PARTNER_MISSING, PARTNER_PUSH), partner),
        (detail.isin("Unknown", "CRM / Newsletter"), detail),
    ]
    return rules


def attribute_channels(installs: DataFrame, owned: OwnedChannels = OwnedChannels()) -> DataFrame:
    """Add ``install_source_detail`` and ``install_source``."""
    detailed = apply_rules(installs, "install_source_detail", source_detail_rules(), "Other")
    return apply_rules(detailed, "install_source", source_rules(owned), "Other")


def geography(country: DataFrame, subcontinent: DataFrame) -> DataFrame:
    """Countries with their region: ``countryiso2``, ``country``, ``subcontinent``."""
    return country.join(subcontinent, "id_subcontinent", "left").select("countryiso2", "country", "subcontinent")


def enrich_geo(df: DataFrame, code_col: str, country: DataFrame, subcontinent: DataFrame,
               overrides: Mapping[str, str] = {"GB": "UK"}) -> DataFrame:
    """Add ``ip_country`` and ``ip_region`` by country code.

    A code in ``overrides`` names both the country and the region.
    """
    geo = geography(country, subcontinent).withColumnRenamed("countryiso2", "__iso")
    joined = df.join(geo, F.col(code_col) == F.col("__iso"), "left")
    named = rule_chain([(F.col(code_col) == code, name) for code, name in overrides.items()], F.col("country"))
    placed = rule_chain([(F.col("ip_country") == name, name) for name in overrides.values()], F.col("subcontinent"))
    return (joined.withColumn("ip_country", named).withColumn("ip_region", placed)
            .drop("__iso", "country", "subcontinent"))
