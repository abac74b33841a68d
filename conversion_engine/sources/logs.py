"""Filtered scans of the two logs.

Both logs are read as bounded batches. Filters are written on raw columns so
that they reach the Parquet scan; JSON is parsed once per row, after them.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conversion_engine.functions.semantics import iso_timestamp, json_fields, like_any, typed_text
from conversion_engine.operators.identity import event_user_key, session_key
from conversion_engine.sources.schemas import SCHEMAS

# Event parameters the funnels read, with the type each is read as.
EVENT_PARAMETERS = {
    "arrival_date": "date",
    "departure_date": "date",
    "destination_city": "string",
    "destination_country": "string",
    "lead_time": "string",
    "number_guests": "int",
    "action": "string",
    "number_results": "int",
    "page_type": "string",
    "panel_clicked": "string",
    "item_id": "string",
    "item_category": "string",
    "position": "string",
    "step_name": "string",
    "checkout_room_types": "string",
}
MOBILE_PLATFORMS = ("ios", "android")
STAGING_VERSION = "%staging%"
DATA_LAG_DAYS = 2


def as_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def latest_complete_day(as_of: str | dt.date, lag_days: int = DATA_LAG_DAYS) -> dt.date:
    """The last day whose data is taken as complete on the day ``as_of``.

    The run date is an argument, so the same call gives the same rows later.
    """
    return as_date(as_of) - dt.timedelta(days=lag_days)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A domain table from Parquet, under its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Write a result table. Logs want ``partition_by`` their event date."""
    columns = list(partition_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def replace_days(df: DataFrame, path: str, days: Iterable[str | dt.date], by: str = "event_date") -> None:
    """Put the rows of ``days`` into a table kept in one folder per day of ``by``, in place of what those days had.

    The rows are written beside the table first; then each day's folder is put in the old one's place, or the old one
    goes if the day has no rows now. Other days' files are not touched, and a run that is repeated, whole or after it broke off, gives
    the same table. Rows of other days are left out.
    """
    spark, days = df.sparkSession, sorted({as_date(d) for d in days})
    stage = f"{path}/_stage-{uuid.uuid4().hex}"
    # A day's rows come together first (a large day in several parts): files don't grow with tasks times days.
    df.where(F.col(by).isin(days)).hint("rebalance", by).write.partitionBy(by).parquet(stage)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for day in days:  # as many as this run has
        made, place = folder(f"{stage}/{by}={day.isoformat()}"), folder(f"{path}/{by}={day.isoformat()}")
        fs.delete(place, True)
        if fs.exists(made) and not fs.rename(made, place):
            raise OSError(f"could not put {place.toString()} in place")
    fs.delete(folder(stage), True)


def read_days(spark: SparkSession, path: str, schema: T.StructType, by: str = "event_date") -> DataFrame:
    """A table written by ``replace_days``; without rows if no day has any. Its days are folders, so filters on them skip files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder(path)) or not any(s.getPath().getName().startswith(f"{by}=") for s in fs.listStatus(folder(path))):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(schema.names)


def read_event_log(log: DataFrame, names: Iterable[str] | None, start: str | dt.date, end: str | dt.date,
                   ts_col: str = "timestamp_iso", name_col: str = "name") -> DataFrame:
    """Rows of the named events between two days, with ``event_ts`` and ``event_date``.

    Text timestamps get a second, one day wider range on the text itself: it
    holds for every zone suffix, so it never loses a row, and unlike the parsed
    value it can skip Parquet row groups.
    """
    start, end = as_date(start), as_date(end)
    rows = log
    if names is not None:
        rows = rows.where(F.col(name_col).isin(*names))
    if isinstance(log.schema[ts_col].dataType, T.StringType):
        day = dt.timedelta(days=1)
        rows = rows.where(
            (F.col(ts_col) >= F.lit((start - day).isoformat()))
            & (F.col(ts_col) < F.lit((end + 2 * day).isoformat()))
        )
        stamp = iso_timestamp(ts_col)
    else:
        stamp = F.col(ts_col).cast("timestamp_ntz")
    return (
        rows.withColumn("event_ts", stamp)
        .withColumn("event_date", F.to_date("event_ts"))
        .where(F.col("event_date").between(F.lit(start), F.lit(end)))
    )


def release_version(version: Column, excluded: str = STAGING_VERSION) -> Column:
    """True for released builds. A missing version is not a released build."""
    return ~version.ilike(excluded)


def normalize_events(events: DataFrame, start: str | dt.date, end: str | dt.date,
                     params: Mapping[str, str] = EVENT_PARAMETERS, only: Column | None = None,
                     platforms: Iterable[str] | None = MOBILE_PLATFORMS,
                     exclude_version: str = STAGING_VERSION) -> DataFrame:
    """The app-event log as typed columns, one row per event.

    One shared scan for every funnel: date, platform and build filters, the
    event parameters in ``params``, and the user and session keys. Each JSON
    column is parsed once per row; only the named keys are read from it. ``only`` is a condition on raw
    columns, tested before any parsing.
    """
    rows = events.where(F.col("event_date").between(F.lit(as_date(start)), F.lit(as_date(end))))
    if platforms is not None:
        rows = rows.where(like_any("platform", platforms, ignore_case=True))
    if only is not None:
        rows = rows.where(only)
    # Conditions on parsed values are not pushed below a generator, so that nothing is parsed twice.
    parsed = rows.select(
        "event_date", "event_name", "platform", "profile_id", "user_pseudo_id",
        F.inline(F.array(F.struct(
            json_fields("event_parameters", ["segment_anonymous_id", "ga_session_id", *params]).alias("ep"),
            json_fields("user_properties", ["ga_session_id", "first_open_time", "userId"]).alias("up"),
            json_fields("app_info", ["version"]).getField("version").alias("version")))),
    ).where(release_version(F.col("version"), exclude_version))
    typed = parsed.select(
        "event_date", "event_name", "platform", "profile_id", "user_pseudo_id", "version",
        F.col("ep.segment_anonymous_id").alias("anonymous_id"),
        F.coalesce("ep.ga_session_id", "up.ga_session_id").alias("ga_session"),
        F.col("up.first_open_time").alias("first_open_time"),
        F.col("up.userId").alias("account_id"),
        *[typed_text(F.col("ep").getField(key), kind).alias(key) for key, kind in params.items()],
    )
    return typed.select(
        "event_date", "event_name", "platform", "version", "profile_id",
        event_user_key().alias("user_key"),
        session_key(event_user_key()).alias("session_key"),
        *params,
    )
