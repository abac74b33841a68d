"""Who a row belongs to: devices, users and profiles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conversion_engine.functions.semantics import ColumnLike, as_col
from conversion_engine.operators.joins import left_join_sparse

# Identifiers that stand for "no identifier".
ZERO_DEVICE = "00000000-0000-0000-0000-000000000000"
UNDEFINED_ID = "undefined"
MIN_ID_LENGTH = 6


def device_key(*id_columns: ColumnLike) -> Column:
    """The first identifier that is present, as text."""
    return F.coalesce(*[as_col(c).cast("string") for c in id_columns])


def event_user_key(anonymous_id: ColumnLike = "anonymous_id", pseudo_id: ColumnLike = "user_pseudo_id",
                   session: ColumnLike = "ga_session", first_open: ColumnLike = "first_open_time",
                   profile: ColumnLike = "profile_id", account: ColumnLike = "account_id") -> Column:
    """The best available user identifier of an event.

    Order: anonymous id, pseudo id, session joined with first-open time (only
    if both are known), profile id, account id.
    """
    return F.coalesce(
        as_col(anonymous_id).cast("string"),
        as_col(pseudo_id).cast("string"),
        F.concat(as_col(session).cast("string"), as_col(first_open).cast("string")),
        as_col(profile).cast("string"),
        as_col(account).cast("string"),
    )


def session_key(user_key: Column, session: ColumnLike = "ga_session",
                first_open: ColumnLike = "first_open_time", date: ColumnLike = "event_date") -> Column:
    """User, session and day as one text; NULL if any of them is unknown."""
    return F.concat(
        user_key,
        F.coalesce(as_col(session).cast("string"), as_col(first_open).cast("string")),
        as_col(date).cast("string"),
    )


def identity_map(log: DataFrame, device: ColumnLike, id_col: ColumnLike, min_length: int = MIN_ID_LENGTH,
                 undefined: str = UNDEFINED_ID) -> DataFrame:
    """One profile per device: the largest valid id text, read as a number.

    Output: ``device_id``, ``profile_id``. Partial aggregation sends one row per
    device and task through the shuffle.
    """
    ids = log.select(as_col(device).alias("device_id"), as_col(id_col).alias("__id"))
    valid = ids.where((F.length("__id") >= min_length) & (F.col("__id") != undefined))
    return valid.groupBy("device_id").agg(F.max("__id").try_cast("bigint").alias("profile_id"))


def user_identity_map(events: DataFrame, user_key: str = "user_key", profile: str = "profile_id",
                      session: str = "session_key") -> DataFrame:
    """One profile per user key: the one with most distinct sessions, then the largest id.

    Sessions are counted by first making (user, profile, session) distinct, so a
    user key with very many events is spread over the shuffle by session.
    """
    known = events.where(F.col(profile).isNotNull())
    per_pair = known.groupBy(user_key, profile).agg(F.countDistinct(session).alias("sessions"))
    return per_pair.groupBy(user_key).agg(
        F.max_by(profile, F.struct("sessions", profile)).alias(profile),
        F.max("sessions").alias("sessions"),
    )


def resolve_identity(events: DataFrame, user_map: DataFrame, spread_by: Iterable[ColumnLike],
                     user_key: str = "user_key", profile: str = "profile_id") -> DataFrame:
    """Fill missing profiles from the user map; known profiles stay.

    Only rows without a profile need the lookup. The others get a join key that
    matches nothing and is spread over the partitions by ``spread_by``.
    """
    mapped = user_map.select(F.col(user_key).alias("__mapped_key"), F.col(profile).alias("__mapped_profile"))
    joined = left_join_sparse(events, mapped, user_key, "__mapped_key", spread_by,
                              usable=F.col(profile).isNull())
    return joined.withColumn(profile, F.coalesce(F.col(profile), F.col("__mapped_profile"))).drop("__mapped_profile")


def single_owner_devices(df: DataFrame, device: str, customer: str, max_owners: int = 1) -> DataFrame:
    """Devices with at most ``max_owners`` distinct known customers, with their count."""
    if max_owners == 1:
        # Two extremes decide this, without a distinct count.
        bounds = df.groupBy(device).agg(F.min(customer).alias("__lo"), F.max(customer).alias("__hi"))
        kept = bounds.where(F.col("__lo").isNull() | (F.col("__lo") == F.col("__hi")))
        return kept.select(device, F.when(F.col("__lo").isNull(), 0).otherwise(1).cast("bigint").alias("owners"))
    counts = df.groupBy(device).agg(F.countDistinct(customer).alias("owners"))
    return counts.where(F.col("owners") <= max_owners)
