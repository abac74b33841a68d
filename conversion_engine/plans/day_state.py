"""The event log as day state: what the analysis needs of each day, added day by day and merged when asked for.

A day's events are parsed once, when the day is added. Later runs read the kept partial counts, which have a row per profile, user key and day,
and never the events of earlier days again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conversion_engine.operators import funnel
from conversion_engine.operators.cohort import PREVIOUS_APP_VERSIONS, version_rule
from conversion_engine.plans.conversion import ConversionJob, ConversionPeriod, ConversionTables
from conversion_engine.session import discard, run_folder
from conversion_engine.sources.logs import MOBILE_PLATFORMS, as_date, normalize_events, read_days, replace_days
from conversion_engine.sources.schemas import SCHEMAS


class DayState:
    """Three tables below ``path``, each in one folder per day:

    ``funnels``: partial counts of all funnels per (day, profile, user key, distinct search);
    ``users``: sessions per (day, user key, profile), which a session's day makes add up;
    ``usage``: profiles that used an earlier app version.

    ``_days`` holds a mark for every day that was added, events or not.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.specs, self.search = list(funnel.count_specs().values()), funnel.search_spec()

    def _made(self, events: DataFrame) -> dict[str, DataFrame]:
        earlier = {k: v for k, v in PREVIOUS_APP_VERSIONS.items() if k.lower() in MOBILE_PLATFORMS}
        return {
            "funnels": funnel.daily_partials(events, self.specs, self.search),
            "users": events.where("profile_id IS NOT NULL").groupBy("event_date", "user_key", "profile_id").agg(
                F.countDistinct("session_key").alias("sessions")),
            "usage": events.where(version_rule(earlier)).select("event_date", "profile_id").distinct(),
        }

    @cached_property
    def _schemas(self) -> dict:
        empty = self.spark.createDataFrame([], SCHEMAS["event_log"])
        return {name: df.schema for name, df in self._made(normalize_events(empty, "2000-01-01", "2000-01-01")).items()}

    def add(self, event_log: DataFrame, start: str | dt.date, end: str | dt.date | None = None) -> None:
        """Add the days from ``start`` to ``end``, or put them in place of what was added for them before.

        Only these days of the log are read; their filter reaches its scan.
        """
        start = as_date(start)
        days = [start + dt.timedelta(days=i) for i in range((as_date(end or start) - start).days + 1)]
        events, parsed = normalize_events(event_log, start, days[-1]), f"{run_folder(self.spark)}/day-events-{uuid.uuid4().hex}"
        events.write.parquet(parsed)  # parsed once for the three tables
        for name, df in self._made(self.spark.read.schema(events.schema).parquet(parsed)).items():
            replace_days(df, f"{self.path}/{name}", days)
        discard(self.spark, parsed)
        marks = [(d.isoformat(),) for d in days]
        self.spark.createDataFrame(marks, "day string").coalesce(1).write.mode("append").parquet(f"{self.path}/_days")

    def days(self) -> set[dt.date]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_days")
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(folder):
            return set()
        return {as_date(r["day"]) for r in self.spark.read.schema("day string").parquet(f"{self.path}/_days").distinct().collect()}

    def table(self, name: str, start: dt.date, end: dt.date) -> DataFrame:
        rows = read_days(self.spark, f"{self.path}/{name}", self._schemas[name])
        return rows.where(F.col("event_date").between(F.lit(start), F.lit(end)))


class IncrementalJob(ConversionJob):
    """The analysis with its event log from day state; the other tables are read as they are.

    All days from the first install to the end of the data must have been added.
    """

    def __init__(self, tables: ConversionTables, period: ConversionPeriod, state: DayState, parity: bool = False):
        super().__init__(tables, period, parity)
        self.state = state
        span = (period.data_end - period.install_start).days + 1
        missing = {period.install_start + dt.timedelta(days=i) for i in range(span)} - state.days()
        if missing:
            raise ValueError(f"days that were not added: {', '.join(map(str, sorted(missing)))}")

    @cached_property
    def user_map(self) -> DataFrame:
        pairs = self.state.table("users", self.p.install_start, self.p.data_end).groupBy("user_key", "profile_id").agg(
            F.sum("sessions").alias("sessions"))
        return pairs.groupBy("user_key").agg(F.max_by("profile_id", F.struct("sessions", "profile_id")).alias("profile_id"),
                                             F.max("sessions").alias("sessions"))

    def funnel_partials(self, chosen: Iterable[funnel.FunnelSpec], search: funnel.FunnelSpec | None) -> DataFrame:
        return self.state.table("funnels", self.p.install_start, self.p.data_end)

    def earliest_usage(self) -> DataFrame:
        return self.state.table("usage", self.p.usage_start, self.p.install_end).groupBy("profile_id").agg(
            F.min("event_date").alias("earliest_app_usage"))


def write_report(wide: DataFrame, path: str, install_days: Iterable[str | dt.date]) -> None:
    """The wide table in one folder per install day: the named days are replaced, the others keep their files."""
    replace_days(wide, path, install_days, by="install_date")
