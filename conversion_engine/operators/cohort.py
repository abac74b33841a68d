"""The installed devices under analysis."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conversion_engine.functions.semantics import (
    ColumnLike,
    as_col,
    day_offset,
    flag,
    json_fields,
    like_any,
    weekend_flag,
    within_days,
)
from conversion_engine.operators.attribution import OwnedChannels, ad_partner, attribute_channels, enrich_geo, first_touch
from conversion_engine.operators.identity import ZERO_DEVICE, device_key
from conversion_engine.operators.joins import in_calendar, left_join_sparse
from conversion_engine.sources.logs import as_date, read_event_log, release_version
from conversion_engine.sources.schemas import DEVICE_ID_COLUMNS

# A platform that is no phone, and version prefixes of the app's predecessor.
EXCLUDED_INSTALL_PLATFORM = "TV_APP"
PREVIOUS_APP_VERSIONS = {"ios": ("12%", "13%"), "android": ("9%",)}


def device_installs(log: DataFrame, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """First-touch attributes of every installed device, one row per device.

    The placeholder device and rows without any identifier are dropped before
    the shuffle.
    """
    rows = (
        read_event_log(log, ["INSTALL"], start, end)
        .where(F.col("user_data_platform") != EXCLUDED_INSTALL_PLATFORM)
        .withColumn("device_id", device_key(*DEVICE_ID_COLUMNS))
        .where(F.col("device_id") != ZERO_DEVICE)
    )
    return first_touch(rows, "device_id", "event_ts", {
        "campaign": "campaign",
        "channel": "channel",
        "feature": "feature",
        "ad_partner": ad_partner("advertising_partner_name"),
        "marketing_title": "marketing_title",
        "install_timestamp": "event_ts",
        "platform": "user_data_platform",
        "brand": "user_data_brand",
        "ip_country_code": "user_data_geo_country_code",
    }).withColumn("install_date", F.to_date("install_timestamp"))


def attributed_installs(log: DataFrame, identities: DataFrame, country: DataFrame, subcontinent: DataFrame,
                        start: str | dt.date, end: str | dt.date, owned: OwnedChannels = OwnedChannels()) -> DataFrame:
    """Installs with channel, geography and profile."""
    installs = attribute_channels(device_installs(log, start, end), owned)
    placed = enrich_geo(installs, "ip_country_code", country, subcontinent)
    return placed.join(identities, "device_id", "left")


def latest_record(df: DataFrame, key: str, order: str, columns: Iterable[str]) -> DataFrame:
    """The rows of the latest ``order`` value per key; ties are kept, repeats are not.

    Repeated rows go first, which leaves few rows per key and order value.
    """
    distinct = df.select(key, order, *columns).distinct()
    ranked = distinct.withColumn("__rank", F.rank().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def push_flag(opt_in: ColumnLike = "push_opt_in") -> Column:
    return flag(as_col(opt_in) == "TRUE")


def current_push_status(push: DataFrame) -> DataFrame:
    """One row per profile: the flag on the latest day (1 wins a tie) and how many
    different flags that day has. One grouped aggregation."""
    rows = push.groupBy("id_profile", "date_push").agg(
        F.max(push_flag()).alias("__hi"), F.min(push_flag()).alias("__lo"))
    latest = F.max(F.struct("date_push", "__hi", "__lo"))
    top = rows.groupBy("id_profile").agg(latest.alias("top"))
    return top.select("id_profile", F.col("top.date_push").alias("date_push"),
                      F.col("top.__hi").alias("push_yn"),
                      F.when(F.col("top.__hi") == F.col("top.__lo"), 1).otherwise(2).alias("push_states"))


def install_cohort(devices: DataFrame, calendar: DataFrame, push: DataFrame,
                   start: str | dt.date, end: str | dt.date, parity: bool = False) -> DataFrame:
    """Installed devices with at most one customer, one row per device.

    ``devices`` comes from ``booking_summary``. With ``parity`` a booking counts
    once per different push flag of the latest push day.
    """
    owned = devices.where(
        (F.col("owners") <= 1) & F.col("install_date").between(F.lit(as_date(start)), F.lit(as_date(end))))
    dated = in_calendar(owned, "install_date", calendar)
    status = current_push_status(push).withColumnRenamed("id_profile", "__push_profile")
    joined = left_join_sparse(dated, status, "profile_id", "__push_profile", ["device_id"])
    bookings = F.col("days0to28_app_bookings")
    if parity:
        bookings = bookings * F.coalesce("push_states", F.lit(1))
    return joined.select(
        "device_id", "profile_id", "install_date",
        weekend_flag("install_date").alias("installed_on_weekend"),
        "platform", "install_source", "install_source_detail", "ip_country", "ip_region", "brand",
        "customer_status",
        flag(F.col("profile_id").isNotNull()).alias("profile_created_yn"),
        F.coalesce("push_yn", F.lit(0)).alias("push_yn"),
        F.col("first_booked_date").alias("first_booked_date_post_install"),
        bookings.alias("days0to28_app_bookings"),
    )


def version_rule(rules: Mapping[str, Iterable[str]], platform: ColumnLike = "platform",
                 version: ColumnLike = "version") -> Column:
    """True where the platform's version starts with one of its prefixes."""
    condition = F.lit(False)
    for name, patterns in rules.items():
        condition = condition | (as_col(platform).ilike(name) & like_any(version, patterns, ignore_case=True))
    return condition


def earliest_usage(events: DataFrame, start: str | dt.date, end: str | dt.date,
                   rules: Mapping[str, Iterable[str]] = PREVIOUS_APP_VERSIONS) -> DataFrame:
    """First day of use of an earlier app version, one row per profile."""
    rows = events.where(
        F.col("event_date").between(F.lit(as_date(start)), F.lit(as_date(end)))
        & like_any("platform", list(rules), ignore_case=True)
    ).select("event_date", "platform", "profile_id",
             # Conditions on the version are not pushed below a generator, so that each row is parsed once.
             F.explode(F.array(json_fields("app_info", ["version"]).getField("version"))).alias("version"))
    used = rows.where(version_rule(rules) & release_version(F.col("version")))
    return used.groupBy("profile_id").agg(F.min("event_date").alias("earliest_app_usage"))


def eligible(earliest: ColumnLike = "earliest_app_usage", install_date: ColumnLike = "install_date",
             status: ColumnLike = "customer_status", bookings: ColumnLike = "days0to28_app_bookings",
             profile_created: ColumnLike = "profile_created_yn", lo: int = 0, hi: int = 28) -> Column:
    """New or no customers with a profile, who did not use the app before."""
    fresh = as_col(earliest).isNull() | within_days(earliest, install_date, lo, hi)
    converted = (as_col(status) == "New Customer") & (as_col(bookings) > 0)
    return fresh & ((as_col(status) == "Not a Customer") | converted) & (as_col(profile_created) == 1)


def analysis_cohort(installs: DataFrame, activity: DataFrame, milestones: DataFrame, earliest: DataFrame,
                    hi: int = 28) -> DataFrame:
    """Eligible installs with their activity and milestones, one row per device.

    ``activity`` comes from ``activity_summary`` of OPEN and LOGIN, ``milestones`` from
    ``milestone_summary``, ``earliest`` from ``earliest_usage``.
    """
    used = (earliest.select(F.col("profile_id").try_cast("bigint").alias("profile_id"), "earliest_app_usage")
            .groupBy("profile_id").agg(F.min("earliest_app_usage").alias("earliest_app_usage")))
    candidates = installs.where(eligible(earliest=F.lit(None).cast("date")))
    fresh = candidates.join(used, "profile_id", "left").where(eligible()).drop("earliest_app_usage")
    used_app = activity.select(
        "device_id", "install_date",
        F.col("OPEN.first_date").alias("first_app_open_date"),
        F.col("OPEN.days_to_first").alias("days_to_first_app_open"),
        F.col("OPEN.actions").alias("app_open_count"),
        F.col("OPEN.active_days").alias("app_open_days"),
        F.col("OPEN.actions_per_active_day").alias("avg_app_opens_per_day"),
        F.col("OPEN.last_date").alias("last_app_open_date"),
        F.col("OPEN.days_to_last").alias("days_to_last_app_open"),
        F.col("LOGIN.first_date").alias("first_login_post_install"),
        F.col("LOGIN.days_to_first").alias("days_to_first_login"),
        F.col("LOGIN.actions").alias("login_count"),
    )
    joined = (
        fresh.join(used_app, ["device_id", "install_date"], "left")
        .join(milestones, ["profile_id", "install_date"], "left")
    )
    return joined.select(
        *installs.columns,
        "first_app_open_date", "days_to_first_app_open", "app_open_count", "app_open_days",
        "avg_app_opens_per_day", "last_app_open_date", "days_to_last_app_open",
        day_offset(F.date_add("install_date", hi), "last_app_open_date").alias("days_of_inactivity"),
        "first_login_post_install",
        flag(F.col("first_login_post_install").isNotNull()).alias("did_user_ever_logged_in"),
        "days_to_first_login", "login_count",
        "profile_info_date", "days_to_first_profile_info", "language_flag", "bio_flag", "city_flag",
        "interest_flag", "all_attributes_flag",
        "pic_uploaded_date", "days_to_first_pic_uploaded",
        "social_toggle_date", "days_to_first_social_toggle_on", "social_member_yn",
    )
