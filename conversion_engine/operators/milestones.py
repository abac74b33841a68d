"""What a user did around the install: opens, logins, profile steps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conversion_engine.functions.semantics import ColumnLike, as_col, day_offset, flag, ratio_or_null
from conversion_engine.operators.identity import ZERO_DEVICE, device_key
from conversion_engine.operators.joins import banded_join
from conversion_engine.sources.logs import read_event_log
from conversion_engine.sources.schemas import DEVICE_ID_COLUMNS

PROFILE_FLAGS = ("language_flag", "bio_flag", "city_flag", "interests_flag")


def activity_days(log: DataFrame, names: Iterable[str], start: str | dt.date, end: str | dt.date,
                  device: Column | None = None) -> DataFrame:
    """Distinct actions per device and day: ``device_id, event_date`` and a count for each of ``names``.

    Repeated rows of one instant count once. The distinct step shuffles by
    device and instant, so a device with very many rows is spread out before
    it is reduced to one row per day. The log is scanned once for all names.
    """
    names = list(names)
    device = device_key(*DEVICE_ID_COLUMNS) if device is None else device
    rows = read_event_log(log, names, start, end).select(device.alias("device_id"), "event_date", "event_ts", "name")
    real = rows.where(F.col("device_id") != ZERO_DEVICE)
    return real.distinct().groupBy("device_id", "event_date").agg(*[F.count_if(F.col("name") == n).alias(n) for n in names])


def activity_summary(days: DataFrame, cohort: DataFrame, names: Iterable[str], lo: int = 0, hi: int = 28) -> DataFrame:
    """Activity in the window, one row per device and install date, and a struct for each of ``names``.

    A struct is NULL where there was none of its actions.

    ``days`` comes from ``activity_days``; ``cohort`` has ``device_id`` and
    ``install_date``.
    """
    keys = cohort.select("device_id", "install_date").distinct()
    rows = banded_join(keys, days, "device_id", "install_date", "event_date", lo, hi)

    def total(name: str) -> Column:
        day = F.when(F.col(name) > 0, F.col("event_date"))
        return F.struct(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.sum(name).alias("actions"),
                        F.count(day).alias("active_days")).alias(name)

    def report(name: str) -> Column:
        t = F.col(name)
        return F.when(t["active_days"] > 0, F.struct(
            t["first_date"].alias("first_date"),
            day_offset(t["first_date"], "install_date").alias("days_to_first"),
            t["last_date"].alias("last_date"),
            day_offset(t["last_date"], "install_date").alias("days_to_last"),
            t["actions"].alias("actions"), t["active_days"].alias("active_days"),
            ratio_or_null(t["actions"], t["active_days"]).alias("actions_per_active_day"))).alias(name)

    names = list(names)
    totals = rows.groupBy("device_id", "install_date").agg(*map(total, names))
    return totals.select("device_id", "install_date", *map(report, names))


def flag_events(df: DataFrame, key: str, date: str, condition: Column, label: ColumnLike,
                start: str | dt.date, end: str | dt.date, label_name: str = "label") -> DataFrame:
    """Distinct (key, date, label) rows where the condition holds."""
    rows = df.where(F.col(date).between(F.lit(start), F.lit(end)) & condition)
    return rows.select(key, date, as_col(label).alias(label_name)).distinct()


def change_points(df: DataFrame, key: str = "profile_id", date: str = "event_date",
                  flags: Iterable[str] = PROFILE_FLAGS) -> DataFrame:
    """Days on which the accumulated 0/1 flags of a key changed and something is set.

    A flag, once set, stays set. So a key can only change on the first day of
    one of its flags, or on the first day on which every flag is known. Those
    few days come out of one grouped aggregation; the history of a key is never
    sorted or gathered in one task.

    Output: key, date, the flags as of that day, ``all_attributes``.
    """
    flags = list(flags)
    first_set = [F.min(F.when(F.col(f) == 1, F.col(date))).alias(f"__set_{f}") for f in flags]
    first_known = [F.min(F.when(F.col(f).isNotNull(), F.col(date))).alias(f"__known_{f}") for f in flags]
    per_key = df.groupBy(key).agg(*first_set, *first_known)
    known = [F.col(f"__known_{f}") for f in flags]
    ready = F.greatest(*known) if len(known) > 1 else known[0]
    for k in known:
        ready = F.when(k.isNotNull(), ready)
    # A flag set before all flags are known shows up on the day they are.
    visible = [F.greatest(F.col(f"__set_{f}"), F.col("__ready")) for f in flags]
    visible = [F.when(F.col(f"__set_{f}").isNotNull(), v) for f, v in zip(flags, visible)]
    days = (
        per_key.withColumn("__ready", ready)
        .where(F.col("__ready").isNotNull())
        .withColumn("__days", F.array_distinct(F.array_compact(F.array(*visible))))
        .withColumn(date, F.explode("__days"))
    )
    as_of = [flag(F.col(f"__set_{f}") <= F.col(date)).alias(f) for f in flags]
    out = days.select(key, date, *as_of)
    return out.withColumn("all_attributes", flag(sum((F.col(f) for f in flags), F.lit(0)) == len(flags)))


def milestone_days(profile_changes: DataFrame, photos: DataFrame, social: DataFrame) -> DataFrame:
    """Profile changes, photo uploads and social switches as one relation per profile and day.

    Inputs: ``change_points`` output keyed ``profile_id, event_date``; photo and
    social rows from ``flag_events`` keyed ``id_profile, created_at``.
    """
    changes = profile_changes.select(
        "profile_id", F.col("event_date").alias("milestone_date"),
        F.col("event_date").alias("profile_info_date"), *PROFILE_FLAGS, "all_attributes")
    uploaded = photos.select(F.col("id_profile").alias("profile_id"), F.col("created_at").alias("milestone_date"),
                             F.col("created_at").alias("pic_uploaded_date"))
    joined = social.select(F.col("id_profile").alias("profile_id"), F.col("created_at").alias("milestone_date"),
                           F.col("created_at").alias("social_toggle_date"), F.col("label").alias("social_member_yn"))
    return (changes.unionByName(uploaded, allowMissingColumns=True)
            .unionByName(joined, allowMissingColumns=True))


def milestone_summary(days: DataFrame, keys: DataFrame, lo: int = 0, hi: int = 28) -> DataFrame:
    """Milestones in the window, one row per profile and install date."""
    rows = banded_join(keys.select("profile_id", "install_date").distinct(), days,
                       "profile_id", "install_date", "milestone_date", lo, hi)
    first = {"profile_info_date": "days_to_first_profile_info",
             "pic_uploaded_date": "days_to_first_pic_uploaded",
             "social_toggle_date": "days_to_first_social_toggle_on"}
    out = rows.groupBy("profile_id", "install_date").agg(
        *[F.min(c).alias(c) for c in first],
        F.max("language_flag").alias("language_flag"),
        F.max("bio_flag").alias("bio_flag"),
        F.max("city_flag").alias("city_flag"),
        F.max("interests_flag").alias("interest_flag"),
        F.max("all_attributes").alias("all_attributes_flag"),
        F.max("social_member_yn").alias("social_member_yn"),
    )
    return out.select("*", *[day_offset(c, "install_date").alias(o) for c, o in first.items()])
