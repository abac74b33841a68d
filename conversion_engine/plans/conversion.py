"""The conversion analysis: from logs, bookings and dimensions to the wide table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conversion_engine.functions.semantics import WINDOW_DAYS, day_offset
from conversion_engine.operators import funnel
from conversion_engine.operators.attribution import OwnedChannels, geography
from conversion_engine.operators.bookings import (
    BookingFilters,
    booking_star,
    booking_summary,
    bookings_after_first_install,
)
from conversion_engine.operators.cohort import analysis_cohort, attributed_installs, earliest_usage, install_cohort
from conversion_engine.operators.features import WIDE_COLUMNS, assemble_features
from conversion_engine.operators.identity import ZERO_DEVICE, device_key, identity_map, user_identity_map
from conversion_engine.operators.joins import left_join_sparse, lookup_ignoring_case
from conversion_engine.operators.milestones import (
    activity_days,
    activity_summary,
    change_points,
    flag_events,
    milestone_days,
    milestone_summary,
)
from conversion_engine.session import materialize, store_bucketed
from conversion_engine.sources.logs import normalize_events, read_event_log, read_table
from conversion_engine.sources.schemas import DEVICE_ID_COLUMNS, SCHEMAS


@dataclass(frozen=True)
class ConversionTables:
    """The twelve inputs; see ``sources.schemas`` for their columns."""

    install_log: DataFrame
    event_log: DataFrame
    booking: DataFrame
    booking_attribution: DataFrame
    customer: DataFrame
    site: DataFrame
    calendar: DataFrame
    country: DataFrame
    subcontinent: DataFrame
    push_status: DataFrame
    social_auth: DataFrame
    profile_attributes: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> ConversionTables:
        return cls(**{name: read_table(spark, f"{root}/{name}", name) for name in SCHEMAS})


@dataclass(frozen=True)
class ConversionPeriod:
    """Date ranges and owner-specific values of one analysis.

    ``data_end`` is the last complete day (see ``latest_complete_day``).
    """

    install_start: dt.date
    install_end: dt.date
    data_end: dt.date
    identity_start: dt.date
    usage_start: dt.date
    site_brand: str
    owned: OwnedChannels = field(default_factory=OwnedChannels)
    window_days: int = WINDOW_DAYS


class ConversionJob:
    """The relations of the analysis, each a lazy DataFrame.

    Relations that several branches read are written once (``materialize``):
    installs, bookings, the cohorts. They have one row per device or booking
    and are small next to the logs.
    """

    def __init__(self, tables: ConversionTables, period: ConversionPeriod, parity: bool = False):
        self.t, self.p, self.parity = tables, period, parity

    # identity

    def identities(self) -> DataFrame:
        log = read_event_log(self.t.install_log, None, self.p.identity_start, self.p.data_end)
        rows = log.withColumn("device_id", device_key(*DEVICE_ID_COLUMNS)).where(F.col("device_id") != ZERO_DEVICE)
        return identity_map(rows, "device_id", F.col("custom_data")["customer_id"])

    @cached_property
    def events(self) -> DataFrame:
        return normalize_events(self.t.event_log, self.p.install_start, self.p.data_end)

    @cached_property
    def user_map(self) -> DataFrame:
        keys_only = normalize_events(self.t.event_log, self.p.install_start, self.p.data_end, params={})
        return user_identity_map(keys_only)

    # installs and bookings

    def installs(self) -> DataFrame:
        return attributed_installs(self.t.install_log, self.identities(), self.t.country, self.t.subcontinent,
                                   self.p.install_start, self.p.install_end, self.p.owned)

    def star(self) -> DataFrame:
        filters = BookingFilters(self.p.install_start, self.p.data_end, self.p.site_brand)
        return booking_star(self.t.booking, self.t.booking_attribution, self.t.customer, self.t.site,
                            self.t.calendar, filters)

    def bookings(self, installs: DataFrame) -> DataFrame:
        """Bookings that can belong to an install, written once."""
        return materialize(bookings_after_first_install(installs, self.star()), "bookings")

    @cached_property
    def devices(self) -> DataFrame:
        installs = materialize(self.installs(), "installs")
        return booking_summary(installs, self.bookings(installs))

    def install_cohort(self) -> DataFrame:
        return install_cohort(self.devices, self.t.calendar, self.t.push_status,
                              self.p.install_start, self.p.install_end, self.parity)

    @cached_property
    def stored_installs(self) -> DataFrame:
        """The install cohort, written once for all that read it."""
        return materialize(self.install_cohort(), "install_cohort")

    @cached_property
    def stored_cohort(self) -> DataFrame:
        """Eligible devices that opened the app, with activity and milestones; written once."""
        opened = self.analysis_cohort(self.stored_installs).where(F.col("first_app_open_date").isNotNull())
        return materialize(opened, "analysis_cohort")

    @cached_property
    def windows(self) -> DataFrame:
        """The profiles and install dates whose windows are reported."""
        return self.stored_cohort.select("profile_id", "install_date").distinct()

    # activity and milestones

    def activity(self, cohort: DataFrame, names: tuple[str, ...] = ("OPEN", "LOGIN")) -> DataFrame:
        days = activity_days(self.t.install_log, names, self.p.install_start, self.p.data_end)
        return activity_summary(days, cohort, names, 0, self.p.window_days)

    def photos(self) -> DataFrame:
        return flag_events(self.t.social_auth, "id_profile", "created_at",
                           F.col("photo_flag") == "Profiles with Photos", F.lit("Photo Uploaded"),
                           self.p.install_start, self.p.data_end)

    def social(self) -> DataFrame:
        return flag_events(self.t.social_auth, "id_profile", "created_at",
                           F.col("social_flag") == "Social Toggle On", F.lit("Y"),
                           self.p.install_start, self.p.data_end)

    def profile_changes(self) -> DataFrame:
        changes = change_points(self.t.profile_attributes)
        return changes.where(F.col("event_date").between(F.lit(self.p.install_start), F.lit(self.p.data_end)))

    def earliest_usage(self) -> DataFrame:
        return earliest_usage(self.t.event_log, self.p.usage_start, self.p.install_end)

    def analysis_cohort(self, installs: DataFrame | None = None) -> DataFrame:
        installs = self.install_cohort() if installs is None else installs
        milestones = milestone_summary(
            milestone_days(self.profile_changes(), self.photos(), self.social()),
            installs.where(F.col("profile_id").isNotNull()), 0, self.p.window_days)
        return analysis_cohort(installs, self.activity(installs), milestones, self.earliest_usage(), self.p.window_days)

    # funnels

    def homes(self, installs: DataFrame) -> DataFrame:
        """Where each profile is at home: the place of its first install.

        With parity: every place of its installs, with the number of installs.
        """
        placed = installs.where(F.col("profile_id").isNotNull())
        if self.parity:
            return placed.groupBy("profile_id", "ip_country", "ip_region").agg(F.count("*").alias("copies"))
        home = F.min_by(F.struct("ip_country", "ip_region"), F.struct("install_date", "device_id"))
        return (placed.groupBy("profile_id").agg(home.alias("home"))
                .select("profile_id", "home.ip_country", "home.ip_region", F.lit(1).cast("bigint").alias("copies")))

    def add_trip(self, homes: DataFrame, how: str = "left"):
        """A step for ``daily_rollup`` that tells the trip type of the searches.

        It works on rows per day, profile and destination, of which a profile
        has few, however much it searched.
        """
        places = geography(self.t.country, self.t.subcontinent)

        def enrich(rows: DataFrame) -> DataFrame:
            known = homes.withColumnRenamed("profile_id", "__home_profile")
            profile = F.col("profile_id").try_cast("bigint")
            if how == "inner":
                at_home = rows.join(known, profile == F.col("__home_profile")).drop("__home_profile")
            else:
                at_home = left_join_sparse(rows, known, profile, "__home_profile",
                                           [funnel.DAY, "destination_country"])
            placed = lookup_ignoring_case(at_home, "destination_country", places, "country",
                                          {"subcontinent": "destination_region"})
            return placed.withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint"))).withColumn(
                "trip", funnel.trip_type("destination_country", "destination_region", "ip_country", "ip_region"))

        return enrich

    def funnel_days(self, names: list[str], installs: DataFrame | None = None,
                    only_cohort: bool = False) -> DataFrame:
        """Daily measures of the named funnels ('search' needs ``installs``).

        With ``only_cohort`` profiles outside ``installs`` are dropped early.
        """
        specs = funnel.count_specs()
        chosen = [specs[n] for n in names if n != "search"]
        search = funnel.search_spec() if "search" in names else None
        enrich = self.add_trip(self.homes(installs), "inner" if only_cohort else "left") if search else None
        profiles = installs.select("profile_id").distinct() if only_cohort else None
        return funnel.merged_days(self.funnel_partials(chosen, search), chosen, self.user_map, search, enrich, profiles)

    def funnel_partials(self, chosen: list[funnel.FunnelSpec], search: funnel.FunnelSpec | None) -> DataFrame:
        """Partial counts per day, profile and user key, from the events of the funnels alone."""
        specs = [*chosen, *([search] if search else [])]
        named, log = funnel.event_filter(specs), self.t.event_log
        if named is not None and any(s.texts for s in specs):
            # The filter tests the parameters many times. It is not pushed below a generator, so that a log that builds them builds them once.
            log = log.withColumn("event_parameters", F.explode(F.array("event_parameters")))
        events = normalize_events(log, self.p.install_start, self.p.data_end, only=named)
        return funnel.daily_partials(events, chosen, search)

    # the wide table

    def wide_features(self) -> DataFrame:
        return _parity_wide(self) if self.parity else _wide(self)


def numeric_profiles(daily: DataFrame) -> DataFrame:
    """Profile ids of the event log are text; the cohort's are numbers."""
    return daily.withColumn("profile_id", F.col("profile_id").try_cast("bigint"))


def _named(cohort: DataFrame) -> DataFrame:
    return cohort.withColumn("idprofile", F.col("profile_id"))


def _wide(job: ConversionJob) -> DataFrame:
    """One row per device: cohort columns, then every funnel of its own window.

    One pass over the event log counts all funnels; one join brings them to the
    cohort. The two cohort relations are read by several branches and are
    therefore written once.
    """
    candidates = job.stored_installs.join(job.windows, "profile_id", "left_semi")
    daily = numeric_profiles(job.funnel_days(["search", *funnel.COUNT_FUNNELS], candidates, only_cohort=True))
    return assembled(job, job.stored_cohort, daily)


class ProfileBuckets:
    """The cohort and its funnel days, stored in buckets by profile.

    Reports over any windows of the cohort (``windows``, ``wide``) then join and group what lies together, without an exchange
    by profile. A profile without a number has no bucket of its own; its rows match nothing.
    """

    def __init__(self, job: ConversionJob, buckets: int | None = None):
        self.job = job
        candidates = job.stored_installs.join(job.windows, "profile_id", "left_semi")
        daily = numeric_profiles(job.funnel_days(["search", *funnel.COUNT_FUNNELS], candidates, only_cohort=True))
        self.cohort = store_bucketed(job.stored_cohort, "cohort", "profile_id", buckets)
        self.daily = store_bucketed(daily.where("profile_id IS NOT NULL"), "funnel_days", "profile_id", buckets)

    def windows(self, names: list[str], lo: int = 0, hi: int = WINDOW_DAYS) -> DataFrame:
        """The named funnels from ``lo`` to ``hi`` days after each install."""
        keys = self.cohort.select("profile_id", "install_date").distinct()
        return funnel.window_rollup(keys, self.daily, [funnel.WINDOW_SPECS[n] for n in names], lo=lo, hi=hi)

    def wide(self) -> DataFrame:
        return assembled(self.job, self.cohort, self.daily)


def assembled(job: ConversionJob, cohort: DataFrame, daily: DataFrame) -> DataFrame:
    """The cohort's rows with every funnel of their windows, from its daily rows."""
    keys = cohort.select("profile_id", "install_date").distinct()
    block = funnel.window_rollup(keys, daily, funnel.WINDOW_SPECS.values(), actions=True, hi=job.p.window_days)
    return assemble_features(_named(cohort), [block], ["profile_id", "install_date"]).select(*WIDE_COLUMNS)


# Funnels reported per (profile, install date), and per profile only.
WINDOW_BLOCKS = ("search", "destination_pages", "recent_search", "property_views", "linkups")
PROFILE_BLOCKS = ("search_steps", "sort_filter", "checkout_starts", "checkout_steps")


def _parity_wide(job: ConversionJob) -> DataFrame:
    """The wide table with the multiplicities of joining on the profile alone.

    A profile with several devices counts its events once per device, and a
    profile with several install dates gets every combination of its window
    blocks. Sums are scaled by the number of devices instead of repeating rows;
    only the last joins, whose rows are the result, multiply.
    """
    installs = job.stored_installs
    cohort = materialize(job.analysis_cohort(installs), "analysis_cohort")
    keys = cohort.groupBy("profile_id", "install_date").agg(F.count("*").alias("devices"))
    profiles = keys.select("profile_id").distinct()
    counted = numeric_profiles(job.funnel_days(list(funnel.COUNT_FUNNELS)))
    counted = materialize(counted.join(profiles, "profile_id", "left_semi"), "funnel_days")
    searches = numeric_profiles(job.funnel_days(["search"], installs.join(profiles, "profile_id", "left_semi"), True))

    hi, specs = job.p.window_days, funnel.WINDOW_SPECS
    plain = [specs[n] for n in specs if n != "search"]
    windows = materialize(funnel.window_rollup(keys, counted, plain, hi=hi, copies="devices"), "windows")
    search = funnel.window_rollup(keys, searches, [specs["search"]], hi=hi, copies="devices")

    def columns(spec: funnel.WindowSpec) -> list[str]:
        buckets = [f"{b.name}_{spec.bucket_suffix}" for b in funnel.BUCKETS] if spec.bucket_suffix else []
        named = [c for c in (spec.first_date, spec.first_offset) if c]
        return [*named, *buckets, *spec.totals, *spec.means, *spec.shares]

    blocks = []
    for name in WINDOW_BLOCKS:
        source = search if name == "search" else windows
        present = source.where(F.col(specs[name].first_date).isNotNull())
        blocks.append(present.select("profile_id", *columns(specs[name])))
    sums = [c for n in PROFILE_BLOCKS for c in columns(specs[n]) if c != specs[n].first_date]
    dates = [specs[n].first_date for n in PROFILE_BLOCKS if specs[n].first_date]
    blocks.append(windows.groupBy("profile_id").agg(*[F.sum(c).alias(c) for c in sums],
                                                    *[F.min(c).alias(c) for c in dates]))
    # Property actions of all windows of a profile, reported again for each install date.
    actions = funnel.window_rollup(keys, counted, actions=True, hi=hi).groupBy("profile_id").agg(
        *[F.sum(c).alias(c) for c in funnel.ACTION_DATES],
        *[F.min(first).alias(first) for first, _ in funnel.ACTION_DATES.values()],
    ).where(F.col("property_page_map_clicks").isNotNull())
    blocks.append(actions.join(keys, "profile_id").select(
        "profile_id",
        *[(F.col(c) * F.col("devices")).alias(c) for c in funnel.ACTION_DATES],
        *[first for first, _ in funnel.ACTION_DATES.values()],
        *[day_offset(first, "install_date").alias(out) for first, out in funnel.ACTION_DATES.values()],
    ))
    opened = _named(cohort).where(F.col("first_app_open_date").isNotNull())
    return assemble_features(opened, blocks, ["profile_id"]).select(*WIDE_COLUMNS)
