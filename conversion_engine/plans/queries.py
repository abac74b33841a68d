"""The registered queries: every operator on the given tables, with its SQL counterpart.

``SPARK`` maps a name to a function of (spark, folder); ``ORACLE`` maps most of
the names to SQL for DuckDB. Numbers with a fraction are rounded on both sides.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conversion_engine.functions import semantics as sem
from conversion_engine.ml import evaluate, explain, training
from conversion_engine.operators import attribution, bookings, cohort, features, funnel, identity, joins
from conversion_engine.plans import commerce
from conversion_engine.plans import oracle_relations as rel
from conversion_engine.plans.conversion import ConversionJob, ConversionTables, ProfileBuckets, numeric_profiles
from conversion_engine.plans.day_state import DayState, IncrementalJob, write_report
from conversion_engine.session import materialize, run_folder
from conversion_engine.sources import logs
from conversion_engine.sources.schemas import DEVICE_ID_COLUMNS, SCHEMAS

Query = Callable[[SparkSession, str], DataFrame]
SPARK: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""
    def register(fn: Query) -> Query:
        SPARK[fn.__name__] = lambda spark, root: rounded(fn(spark, root))
        if oracle is not None:
            ORACLE[fn.__name__] = rel.select(oracle)
        return fn
    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.round(f.name, DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def r(expr: str, name: str) -> str:
    return f"round({expr}, {DIGITS}) AS {name}"


_jobs: dict[tuple, ConversionJob] = {}


def job(spark: SparkSession, root: str, parity: bool = False) -> ConversionJob:
    """The analysis of a folder. Queries of a session share it, and with it the cohorts it has stored, while the folder's files are the same."""
    key = (spark.sparkContext.applicationId, parity, *commerce.files(spark, root))
    if key not in _jobs:
        _jobs[key] = ConversionJob(commerce.tables(spark, root), commerce.PERIOD, parity)
    return _jobs[key]


def star_of(columns: list[str], round_columns: set[str] = frozenset()) -> str:
    return ", ".join(r(c, c) if c in round_columns else c for c in columns)


# --- a complete small query ------------------------------------------------

_view_buckets = ", ".join(
    f"CAST(sum(CASE WHEN v.day - c.install_date BETWEEN {lo} AND {hi} THEN v.n ELSE 0 END) AS BIGINT) AS {b}_views"
    for b, (lo, hi) in rel.BUCKETS.items())


@query(f"""
SELECT user_id, c.install_date, first_view_date, {rel.offset('first_view_date', 'c.install_date')} AS days_to_first_view,
  {', '.join(f'{b}_views' for b in rel.BUCKETS)}
FROM (SELECT u AS user_id, min(day) AS install_date FROM d_events WHERE event_type = 'signup' GROUP BY u) c
LEFT JOIN (
  SELECT c.u, min(v.day) AS first_view_date, {_view_buckets}
  FROM (SELECT u, min(day) AS install_date FROM d_events WHERE event_type = 'signup' GROUP BY u) c
  JOIN (SELECT u, day, count(*) AS n FROM d_events WHERE event_type = 'view' GROUP BY u, day) v
    ON v.u = c.u AND v.day - c.install_date BETWEEN 0 AND 28
  GROUP BY c.u) w ON w.u = c.user_id""")
def install_cohort_view_buckets(spark: SparkSession, root: str) -> DataFrame:
    events = commerce.read(spark, root, "events").select(
        "user_id", "event_type", F.to_date("ts").alias("day"))
    installs = events.where(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("day").alias("install_date"))
    views = events.where(F.col("event_type") == "view").groupBy("user_id", "day").agg(F.count("*").alias("views"))
    offset = sem.day_offset("day", "install_date")
    seen = joins.banded_join(installs, views, "user_id", "install_date", "day").groupBy("user_id", "install_date").agg(
        F.min("day").alias("first_view_date"), *sem.day_buckets(offset, "views", "views"))
    return (features.assemble_features(installs, [seen], ["user_id", "install_date"])
            .withColumn("days_to_first_view", sem.day_offset("first_view_date", "install_date")))


# --- expressions -----------------------------------------------------------


@query("SELECT event_id, k FROM d_events")
def json_param_extract(spark: SparkSession, root: str) -> DataFrame:
    events = commerce.read(spark, root, "events")
    return events.select("event_id", sem.json_value(F.try_parse_json("props"), "k", "int").alias("k"))


_EVENT_COLUMNS = ["event_date", "event_name", "platform", "version", "profile_id", "user_key", "session_key",
                  *logs.EVENT_PARAMETERS]


@query(f"SELECT {', '.join(_EVENT_COLUMNS)} FROM o_events")
def normalized_events(spark: SparkSession, root: str) -> DataFrame:
    return job(spark, root).events


@query(f"""
SELECT l_orderkey, l_linenumber, {rel.offset('l_shipdate', 'o_orderdate')} AS days_to_ship
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def day_offsets(spark: SparkSession, root: str) -> DataFrame:
    lines, orders = commerce.read(spark, root, "lineitem"), commerce.read(spark, root, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", sem.day_offset("l_shipdate", "o_orderdate").alias("days_to_ship"))


@query(f"""
SELECT p_brand, p_type, {r("CASE WHEN sum(CASE WHEN p_size <= 3 THEN 1 ELSE 0 END) = 0 THEN 0.0 "
  "ELSE CAST(sum(CASE WHEN p_size = 1 THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN p_size <= 3 THEN 1 ELSE 0 END) END",
  'smallest_share')}
FROM part GROUP BY p_brand, p_type""")
def div0_shares(spark: SparkSession, root: str) -> DataFrame:
    part = commerce.read(spark, root, "part")
    size = F.col("p_size")
    return part.groupBy("p_brand", "p_type").agg(
        sem.div0(F.sum(sem.flag(size == 1)), F.sum(sem.flag(size <= 3))).alias("smallest_share"))


@query("""
SELECT c.id_customer, CASE WHEN id_date_first_booking IS NOT NULL AND first_order IS NOT NULL
  THEN least(id_date_first_booking, first_order) END AS first_known
FROM d_customer c LEFT JOIN (
  SELECT o_custkey, min(CAST(o_orderdate + INTERVAL 27 YEAR AS DATE)) AS first_order FROM orders GROUP BY o_custkey) o
  ON o.o_custkey = c.id_customer""")
def least_strict_dates(spark: SparkSession, root: str) -> DataFrame:
    customer = commerce.tables(spark, root).customer
    first = commerce.read(spark, root, "orders").groupBy(F.col("o_custkey").alias("id_customer")).agg(
        F.min(F.to_date(F.add_months(F.to_date("o_orderdate"), 27 * 12))).alias("first_order"))
    return customer.join(first, "id_customer", "left").select(
        "id_customer", sem.least_strict("id_date_first_booking", "first_order").alias("first_known"))


@query("SELECT o_orderkey, CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 1 ELSE 0 END AS on_weekend FROM orders")
def weekend_flag(spark: SparkSession, root: str) -> DataFrame:
    orders = commerce.read(spark, root, "orders")
    return orders.select("o_orderkey", sem.weekend_flag(F.to_date("o_orderdate")).alias("on_weekend"))


@query("""
SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1_' AND p_name ILIKE '%RING' THEN 'ring of the tens'
  WHEN p_name ILIKE 'SMALL%' OR p_name ILIKE 'red%' THEN 'small or red'
  WHEN p_name NOT LIKE '%o%' AND p_type IN ('ECONOMY', 'STANDARD') THEN 'plain' ELSE 'other' END AS part_group
FROM part""")
def like_any_rules(spark: SparkSession, root: str) -> DataFrame:
    name = F.col("p_name")
    return attribution.apply_rules(commerce.read(spark, root, "part"), "part_group", [
        (F.col("p_brand").like("Brand#1_") & name.ilike("%RING"), "ring of the tens"),
        (sem.like_any(name, ["SMALL%", "red%"], ignore_case=True), "small or red"),
        (~name.like("%o%") & F.col("p_type").isin("ECONOMY", "STANDARD"), "plain"),
    ], "other").select("p_partkey", "part_group")


# --- identity --------------------------------------------------------------


@query("SELECT name, timestamp_iso, device_id FROM o_devices")
def device_key_coalesce(spark: SparkSession, root: str) -> DataFrame:
    log = commerce.tables(spark, root).install_log
    return log.select("name", "timestamp_iso", identity.device_key(*DEVICE_ID_COLUMNS).alias("device_id"))


_TOUCH = ["device_id", *rel.TOUCHED, "install_timestamp", "install_date"]


@query(f"SELECT {', '.join(_TOUCH)} FROM o_first_touch")
def first_touch_attributes(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    return cohort.device_installs(j.t.install_log, j.p.install_start, j.p.install_end).select(*_TOUCH)


@query("SELECT device_id, profile_id FROM o_identity")
def identity_map_last(spark: SparkSession, root: str) -> DataFrame:
    return job(spark, root).identities()


@query("SELECT user_key, profile_id, sessions FROM o_user_map")
def user_profile_most_sessions(spark: SparkSession, root: str) -> DataFrame:
    return job(spark, root).user_map


@query("""
SELECT event_date, user_key, logged_in, profile_id, count(*) AS events
FROM (SELECT e.event_date, e.user_key, CASE WHEN e.profile_id IS NULL THEN 0 ELSE 1 END AS logged_in,
        coalesce(e.profile_id, m.profile_id) AS profile_id
      FROM o_events e LEFT JOIN o_user_map m ON m.user_key = e.user_key)
GROUP BY ALL""")
def profile_stitching(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    per_day = j.events.groupBy("event_date", "user_key", "profile_id").agg(F.count("*").alias("events"))
    marked = per_day.withColumn("logged_in", sem.flag(F.col("profile_id").isNotNull()))
    stitched = identity.resolve_identity(marked, j.user_map, ["event_date", "user_key"])
    return stitched.select("event_date", "user_key", "logged_in", "profile_id", "events")


@query("SELECT device_id, owners FROM o_owners")
def single_owner_devices(spark: SparkSession, root: str) -> DataFrame:
    owned = job(spark, root).devices.where(F.col("owners") <= 1)
    return owned.select("device_id", F.col("owners").cast("bigint").alias("owners"))


# --- attribution and geography ---------------------------------------------


@query("SELECT device_id, ad_partner, install_source_detail, install_source FROM o_source")
def channel_rules(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    touched = cohort.device_installs(j.t.install_log, j.p.install_start, j.p.install_end)
    return attribution.attribute_channels(touched, j.p.owned).select(
        "device_id", "ad_partner", "install_source_detail", "install_source")


@query("SELECT device_id, ip_country_code, ip_country, ip_region FROM o_placed")
def geo_enrichment(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    touched = cohort.device_installs(j.t.install_log, j.p.install_start, j.p.install_end)
    return attribution.enrich_geo(touched, "ip_country_code", j.t.country, j.t.subcontinent).select(
        "device_id", "ip_country_code", "ip_country", "ip_region")


@query("""
SELECT event_date, destination_country, subcontinent AS destination_region, count(*) AS events
FROM o_events LEFT JOIN d_geo ON lower(country) = lower(destination_country)
WHERE destination_country IS NOT NULL GROUP BY ALL""")
def case_insensitive_lookup(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    places = attribution.geography(j.t.country, j.t.subcontinent)
    per_day = j.events.groupBy("event_date", "destination_country").agg(F.count("*").alias("events"))
    named = per_day.where(F.col("destination_country").isNotNull())
    return joins.lookup_ignoring_case(named, "destination_country", places, "country",
                                      {"subcontinent": "destination_region"})


# --- bookings --------------------------------------------------------------

_STAR = ["id_profile", "id_customer", "id_date_first_booking", "id_first_booking", "id_booking", "booked", "booked_date",
         "arrival_date", "departure_date", "booking_platform"]


@query(f"SELECT {', '.join(_STAR)} FROM o_star")
def booking_star_filtered(spark: SparkSession, root: str) -> DataFrame:
    return job(spark, root).star()


def booking_level(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    installs = materialize(j.installs(), "installs")
    return bookings.attach_bookings(installs, j.bookings(installs))


def _level(columns: list[str]) -> tuple[str, Query]:
    names = ["device_id", "id_booking", *columns]
    return f"SELECT {', '.join(names)} FROM o_level", lambda spark, root: booking_level(spark, root).select(*names)


for _name, _columns in {
    "bookings_after_install": ["profile_id", "install_timestamp", "id_customer", "booked", "booked_date", "first_booked",
                               "first_booked_date", "first_cust_install_timestamp"],
    "booking_day_flags": [f"{b}_app_bookings" for b in rel.BUCKETS],
    "first_booking_day_flags": [f"{b}_first_bkg" for b in rel.BUCKETS if b != "days0to28"],
    "days_to_booking": ["days_to_app_booking_post_install"],
    "trip_pending_flag": ["trip_pending_yn"],
    "customer_status": ["customer_status"],
}.items():
    _sql, _fn = _level(_columns)
    _fn.__name__ = _name
    query(_sql)(_fn)


@query("""
SELECT device_id, min(profile_id) AS profile_id, min(install_date) AS install_date, CAST(count(DISTINCT id_customer) AS INTEGER) AS owners,
  min(customer_status) AS customer_status, CAST(sum(days0to28_app_bookings) AS BIGINT) AS days0to28_app_bookings,
  min(first_booked) AS first_booked, min(first_booked_date) AS first_booked_date
FROM o_level GROUP BY device_id HAVING count(DISTINCT id_customer) <= 1""")
def booking_summary(spark: SparkSession, root: str) -> DataFrame:
    return job(spark, root).devices.where(F.col("owners") <= 1).select(
        "device_id", "profile_id", "install_date", "owners", "customer_status", "days0to28_app_bookings",
        "first_booked", "first_booked_date")


# --- cohort ----------------------------------------------------------------


@query("SELECT id_profile, date_push, push_yn FROM o_push")
def latest_record_per_key(spark: SparkSession, root: str) -> DataFrame:
    push = commerce.tables(spark, root).push_status.withColumn("push_yn", cohort.push_flag())
    return cohort.latest_record(push, "id_profile", "date_push", ["push_yn"])


@query("""
SELECT id_profile, max(date_push) AS date_push, max(push_yn) AS push_yn, CAST(count(*) AS INTEGER) AS push_states
FROM o_push GROUP BY id_profile""")
def current_push_status(spark: SparkSession, root: str) -> DataFrame:
    return cohort.current_push_status(commerce.tables(spark, root).push_status)


@query("""
SELECT id_customer, id_date_first_booking FROM d_customer
WHERE id_date_first_booking IN (SELECT iddate FROM d_calendar)""")
def calendar_semi_join(spark: SparkSession, root: str) -> DataFrame:
    t = commerce.tables(spark, root)
    return joins.in_calendar(t.customer, "id_date_first_booking", t.calendar).select("id_customer", "id_date_first_booking")


@query("""
SELECT iddate, min(iddate) OVER m AS month_start_date, max(iddate) OVER m AS month_end_date
FROM d_calendar WINDOW m AS (PARTITION BY year(iddate), month(iddate))""")
def month_bounds(spark: SparkSession, root: str) -> DataFrame:
    return joins.month_bounds(commerce.tables(spark, root).calendar).select("iddate", "month_start_date", "month_end_date")


_INSTALL_COHORT = [c if c != "idprofile" else "profile_id" for c in features.COHORT_COLUMNS[:15]]


@query(f"SELECT {', '.join(_INSTALL_COHORT)} FROM o_install_cohort")
def install_cohort(spark: SparkSession, root: str) -> DataFrame:
    return job(spark, root).install_cohort()


@query("SELECT profile_id, earliest_app_usage FROM o_earliest")
def earliest_usage(spark: SparkSession, root: str) -> DataFrame:
    return job(spark, root).earliest_usage()


@query("""
SELECT c.device_id, c.profile_id, c.install_date, c.customer_status
FROM o_install_cohort c LEFT JOIN o_earliest e ON CAST(e.profile_id AS BIGINT) = c.profile_id
WHERE (earliest_app_usage IS NULL OR earliest_app_usage - c.install_date BETWEEN 0 AND 28)
  AND (customer_status = 'Not a Customer' OR (customer_status = 'New Customer' AND days0to28_app_bookings > 0))
  AND profile_created_yn = 1""")
def eligibility_filter(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    used = numeric_profiles(j.earliest_usage())
    joined = joins.left_join_sparse(j.stored_installs, used.withColumnRenamed("profile_id", "__used"),
                                    "profile_id", "__used", ["device_id"])
    return joined.where(cohort.eligible()).select("device_id", "profile_id", "install_date", "customer_status")


# --- activity and milestones -----------------------------------------------

_ACTIVITY = ["device_id", "install_date", "first_date", "days_to_first", "last_date", "days_to_last", "actions",
             "active_days", "actions_per_active_day"]
_ACTIVITY_SQL = star_of(_ACTIVITY, {"actions_per_active_day"})


def _activity(name: str) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        j = job(spark, root)
        found = j.activity(j.stored_installs, (name,)).where(F.col(name).isNotNull())
        return found.select("device_id", "install_date", f"{name}.*")
    return run


@query(f"SELECT {_ACTIVITY_SQL} FROM o_opens")
def activity_summary_opens(spark: SparkSession, root: str) -> DataFrame:
    return _activity("OPEN")(spark, root)


@query(f"SELECT {_ACTIVITY_SQL} FROM o_logins")
def activity_summary_logins(spark: SparkSession, root: str) -> DataFrame:
    return _activity("LOGIN")(spark, root)


@query("SELECT id_profile, created_at, label FROM o_photos UNION ALL SELECT id_profile, created_at, label FROM o_social")
def flag_events(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    return j.photos().unionByName(j.social())


@query("SELECT profile_id, event_date, language_flag, bio_flag, city_flag, interests_flag, all_attributes FROM o_changes")
def change_points(spark: SparkSession, root: str) -> DataFrame:
    return job(spark, root).profile_changes()


_COHORT = [c if c != "idprofile" else "profile_id" for c in features.COHORT_COLUMNS]


@query(f"SELECT {star_of(_COHORT, {'avg_app_opens_per_day'})} FROM o_cohort")
def cohort_with_milestones(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    return j.analysis_cohort(j.stored_installs).select(*_COHORT)


# --- funnels ---------------------------------------------------------------

_SEARCH_DAY = ["event_date", "profile_id", "searches_submitted", "search_avg_lead_time", "search_avg_los", "search_avg_pax"]
_TRIPS = ["search_domestic_trip", "search_short_haul_trip", "search_long_haul_trip"]


def search_days(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    return j.funnel_days(["search"], j.stored_installs)


@query(f"SELECT {star_of(_SEARCH_DAY, set(_SEARCH_DAY[3:]))} FROM o_daily_search")
def daily_rollup_search(spark: SparkSession, root: str) -> DataFrame:
    return search_days(spark, root).select(*_SEARCH_DAY)


@query(f"SELECT event_date, profile_id, {', '.join(_TRIPS)} FROM o_daily_search")
def trip_type_counts(spark: SparkSession, root: str) -> DataFrame:
    return search_days(spark, root).select("event_date", "profile_id", *_TRIPS)


def _daily(name: str) -> Query:
    return lambda spark, root: job(spark, root).funnel_days([name])


_DAILY_NAMES = {
    "daily_rollup_pages": ("destination_pages", ["destination_search_pages_viewed"], ["avg_number_properties_returned"]),
    "daily_rollup_filters": ("sort_filter", ["filter_used_count", "sort_used_count"], []),
    "daily_rollup_recent": ("recent_search", ["recent_search_clicks"], []),
    "daily_rollup_views": ("property_views", ["property_page_views", "hostels_viewed", "non_hostels_viewed"],
                           ["viewed_property_avg_position"]),
    "daily_rollup_linkups": ("linkups", ["linkups_view_propt_page"], []),
    "daily_rollup_checkouts": ("checkout_starts", ["checkout_starts"], []),
    "daily_rollup_search_steps": ("search_steps", list(funnel.WINDOW_SPECS["search_steps"].totals), []),
    "daily_rollup_checkout_steps": ("checkout_steps", list(funnel.WINDOW_SPECS["checkout_steps"].totals), []),
}
for _name, (_funnel, _counts, _means) in _DAILY_NAMES.items():
    _fn = _daily(_funnel)
    _fn.__name__ = _name
    query(f"SELECT {star_of(['event_date', 'profile_id', *_counts, *_means], set(_means))} FROM o_daily_{_funnel}")(_fn)


def _window(names: list[str]) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        j = job(spark, root)
        daily = numeric_profiles(j.funnel_days(names, j.stored_installs if "search" in names else None))
        return funnel.window_rollup(j.windows, daily, [funnel.WINDOW_SPECS[n] for n in names])
    return run


def _window_columns(name: str) -> str:
    spec = funnel.WINDOW_SPECS[name]
    buckets = [f"{b.name}_{spec.bucket_suffix}" for b in funnel.BUCKETS] if spec.bucket_suffix else []
    named = [c for c in (spec.first_date, spec.first_offset) if c]
    return star_of(["profile_id", "install_date", *named, *buckets, *spec.totals, *spec.means, *spec.shares],
                   {*spec.means, *spec.shares})


for _name, _funnel in {"window_rollup_search": "search", "window_rollup_pages": "destination_pages",
                       "window_rollup_filters": "sort_filter", "window_rollup_recent": "recent_search",
                       "window_rollup_views": "property_views", "window_rollup_linkups": "linkups",
                       "window_rollup_checkout": "checkout_starts"}.items():
    _fn = _window([_funnel])
    _fn.__name__ = _name
    query(f"SELECT {_window_columns(_funnel)} FROM o_window_{_funnel}")(_fn)


def _steps(name: str) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        j = job(spark, root)
        return funnel.funnel_steps(j.windows, numeric_profiles(j.funnel_days([name])), funnel.WINDOW_SPECS[name])
    return run


for _name, _funnel in {"funnel_steps_search": "search_steps", "funnel_steps_checkout": "checkout_steps"}.items():
    _fn = _steps(_funnel)
    _fn.__name__ = _name
    _totals = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in funnel.WINDOW_SPECS[_funnel].totals)
    query(f"SELECT profile_id, {_totals} FROM o_window_{_funnel} GROUP BY profile_id")(_fn)


@query(f"""SELECT profile_id, install_date, event_date, {', '.join(rel.ACTIONS)},
  {', '.join(f"{c}_date AS {c.replace('_clicks', '_date')}" for c in rel.ACTIONS)} FROM o_action_flags""")
def action_flags(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    return funnel.action_flags(j.windows, numeric_profiles(j.funnel_days(["property_actions"])))


_ACTION_COLUMNS = [c for n, (first, days) in rel.FIRST_ACTION.items() for c in (first, days, n)]


@query(f"SELECT profile_id, install_date, {', '.join(_ACTION_COLUMNS)} FROM o_window_actions")
def action_summary(spark: SparkSession, root: str) -> DataFrame:
    j = job(spark, root)
    return funnel.window_rollup(j.windows, numeric_profiles(j.funnel_days(["property_actions"])), actions=True)


# --- the wide table --------------------------------------------------------

_FRACTIONS = {"avg_app_opens_per_day", "search_avg_lead_time", "search_avg_los", "search_avg_pax",
              "avg_number_properties_returned", "viewed_property_avg_position",
              *[c for c in features.ACTIVITY_COLUMNS if "share" in c]}


def _wide_columns() -> list[str]:
    return [r(c, c) if c in _FRACTIONS else c for c in features.WIDE_COLUMNS]


@query(rel.wide_sql(_wide_columns()))
def wide_feature_table(spark: SparkSession, root: str) -> DataFrame:
    return job(spark, root).wide_features()


@query(rel.parity_sql(_wide_columns()))
def wide_feature_table_parity(spark: SparkSession, root: str) -> DataFrame:
    return job(spark, root, parity=True).wide_features()


_LABELLED = ["device_id", "label", "platform", "install_source", "brand", "push_yn", "app_open_count",
             "searches", "views", "checkouts", "split"]
_BUCKET = "(CAST('0x' || substr(md5(coalesce(CAST(idprofile AS VARCHAR), device_id)), 1, 8) AS BIGINT) % 100)"


@query(f"""
SELECT device_id, CASE WHEN {_BUCKET} < 20 THEN 'validation' ELSE 'train' END AS split, CASE WHEN customer_status = 'New Customer' THEN 1 ELSE 0 END AS label,
  coalesce(platform, 'missing') AS platform, coalesce(install_source, 'missing') AS install_source, coalesce(brand, 'missing') AS brand,
  CAST(push_yn AS DOUBLE) AS push_yn, CAST(app_open_count AS DOUBLE) AS app_open_count,
  coalesce(CAST(days0to28_searches_made AS DOUBLE), -1) AS searches, coalesce(CAST(days0to28_property_views AS DOUBLE), -1) AS views,
  coalesce(CAST(days0to28_checkout_starts AS DOUBLE), 0) AS checkouts
FROM ({rel.wide_sql(features.WIDE_COLUMNS)})""")
def label_and_split(spark: SparkSession, root: str) -> DataFrame:
    wide = job(spark, root).wide_features().select(
        "device_id", "idprofile", "customer_status", "install_date", "days0to28_app_bookings", "platform", "install_source", "brand",
        "push_yn", "app_open_count", F.col("days0to28_searches_made").alias("searches"),
        F.col("days0to28_property_views").alias("views"), F.col("days0to28_checkout_starts").alias("checkouts"))
    prepared = features.prepare_features(wide, features.new_customer_label(), keep=["device_id", "idprofile"],
                                         fills={"checkouts": 0.0})
    return features.assign_split(prepared, _user()).select(*_LABELLED)


def _user() -> Column:
    """Whose rows stay together: a profile has one label, whatever its devices."""
    return F.coalesce(F.col("idprofile").cast("string"), "device_id")


@query(f"""
SELECT device_id, platform, {', '.join(f"CASE WHEN lower(platform) = 'android' THEN 'non_available' ELSE CAST({c} AS VARCHAR) END AS {c}"
                                       for c in features.IOS_ONLY_COLUMNS)}
FROM ({rel.wide_sql(features.WIDE_COLUMNS)})""")
def platform_marking(spark: SparkSession, root: str) -> DataFrame:
    wide = job(spark, root).wide_features().select("device_id", "platform", *features.IOS_ONLY_COLUMNS)
    return features.mark_unavailable(wide)


@query(rel.wide_sql(_wide_columns()))
def wide_feature_table_stored(spark: SparkSession, root: str) -> DataFrame:
    """The wide table from the twelve tables as a user keeps them: written, then read from one folder."""
    folder, source = f"{run_folder(spark)}/domain-{uuid.uuid4().hex}", commerce.tables(spark, root)
    for name in SCHEMAS:
        logs.write_table(getattr(source, name), f"{folder}/{name}")
    return ConversionJob(ConversionTables.read(spark, folder), commerce.PERIOD).wide_features()


def _added(spark: SparkSession, source: commerce.CommerceTables) -> DayState:
    """The event log as day state, added in four runs, one of them twice."""
    state = DayState(spark, f"{run_folder(spark)}/days-{uuid.uuid4().hex}")
    for start, end in ((3, 10), (11, 20), (21, 24), (25, 27), (21, 24)):
        state.add(source.event_log, dt.date(2024, 1, start), dt.date(2024, 1, end))
    state.add(source.event_log, dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    return state


@query(rel.wide_sql(_wide_columns()))
def wide_feature_table_incremental(spark: SparkSession, root: str) -> DataFrame:
    """The wide table from day state, written by install day in two runs, and read back."""
    source = commerce.tables(spark, root)
    wide = IncrementalJob(source, commerce.PERIOD, _added(spark, source)).wide_features()
    path = f"{run_folder(spark)}/report-{uuid.uuid4().hex}"
    days = [commerce.PERIOD.install_start + dt.timedelta(days=i)
            for i in range((commerce.PERIOD.install_end - commerce.PERIOD.install_start).days + 1)]
    write_report(wide, path, days)
    write_report(wide, path, days[-3:])
    return logs.read_days(spark, path, wide.schema, by="install_date")


@query(rel.wide_sql(_wide_columns()))
def wide_feature_table_bucketed(spark: SparkSession, root: str) -> DataFrame:
    """The wide table from the cohort and its funnel days, both stored in buckets by profile."""
    return ProfileBuckets(job(spark, root)).wide()


@query("SELECT user_key, profile_id, sessions FROM o_user_map")
def user_map_incremental(spark: SparkSession, root: str) -> DataFrame:
    source = commerce.tables(spark, root)
    return IncrementalJob(source, commerce.PERIOD, _added(spark, source)).user_map


# --- category rates --------------------------------------------------------

# Priorities as categories: some unknown, one kind seen in a single fold, one not seen before.
rel.RELATIONS["o_categories"] = """
SELECT o_orderkey, o_orderkey % 5 AS fold, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 3 AND o_custkey % 3 = 0 THEN 'ONE FOLD' ELSE o_orderpriority END AS category
FROM orders"""
rel.RELATIONS["o_category_folds"] = "SELECT category, fold, sum(label) AS p, count(*) AS n FROM o_categories GROUP BY ALL"
rel.RELATIONS["o_category_learned"] = """
SELECT category, sum(p) AS p, sum(n) AS n FROM o_category_folds WHERE category IS DISTINCT FROM '5-LOW' GROUP BY 1"""


def _categories(spark: SparkSession, root: str, unseen: str | None = None) -> tuple[DataFrame, training.CategoryStatistics]:
    """All orders with their category, and its statistics, learned from all orders but those of one ``unseen`` value."""
    key = F.col("o_orderkey")
    category = F.when(key % 7 == 0, None).when((key % 5 == 3) & (F.col("o_custkey") % 3 == 0), "ONE FOLD") \
        .otherwise(F.col("o_orderpriority"))
    rows = commerce.read(spark, root, "orders").select(
        "o_orderkey", (key % 5).cast("int").alias("fold"), sem.flag(F.col("o_orderstatus") == "F").alias("label"),
        category.alias("category"))
    learned = rows.where(~F.col("category").eqNullSafe(unseen)) if unseen else rows
    prior = learned.agg(F.avg("label")).first()[0]
    return rows, training.category_statistics(learned, "category", "label", training.TrainingParams(), prior)


@query(f"""
SELECT o_orderkey, {r("coalesce((p + prior) / (n + 1), prior)", "rate")}
FROM o_categories LEFT JOIN o_category_learned USING (category), (SELECT sum(p) / sum(n) AS prior FROM o_category_learned)""")
def category_rates_scoring(spark: SparkSession, root: str) -> DataFrame:
    rows, statistics = _categories(spark, root, unseen="5-LOW")
    return statistics.encode(rows, ["o_orderkey"]).select("o_orderkey", F.col(statistics.output).alias("rate"))


@query(f"""
SELECT o_orderkey, {r("coalesce((t.p - f.p + prior) / (t.n - f.n + 1), prior)", "rate")}
FROM o_categories c LEFT JOIN o_category_folds f ON c.category = f.category AND c.fold = f.fold
  LEFT JOIN (SELECT category, sum(p) AS p, sum(n) AS n FROM o_category_folds GROUP BY 1) t ON t.category = f.category,
  (SELECT sum(p) / sum(n) AS prior FROM o_category_folds)""")
def category_rates_out_of_fold(spark: SparkSession, root: str) -> DataFrame:
    rows, statistics = _categories(spark, root)
    own = statistics.encode_out_of_fold(rows, ["o_orderkey"])
    return own.select("o_orderkey", F.col(statistics.output).alias("rate"))


# --- evaluation on a fixed score -------------------------------------------

_SCORE_SQL = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  CAST((o_custkey * 37 + o_orderkey * 11) % 700 + CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '4' THEN 300 ELSE 100 END AS DOUBLE) / 1000 AS score
FROM orders"""
rel.RELATIONS["o_scored"] = _SCORE_SQL.strip()
rel.RELATIONS["o_predicted"] = "SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction FROM o_scored"
rel.RELATIONS["o_confusion"] = """
SELECT l.x AS label, p.x AS prediction, count(o_orderkey) AS row_count
FROM (VALUES (0), (1)) l(x) CROSS JOIN (VALUES (0), (1)) p(x)
LEFT JOIN o_predicted s ON s.label = l.x AND s.prediction = p.x GROUP BY 1, 2"""
rel.RELATIONS["o_class_scores"] = """
SELECT c.label AS class, sum(c.row_count) AS support,
  sum(CASE WHEN c.prediction = c.label THEN c.row_count ELSE 0 END) AS hits,
  (SELECT sum(row_count) FROM o_confusion x WHERE x.prediction = c.label) AS claimed
FROM o_confusion c GROUP BY c.label"""
rel.RELATIONS["o_class_metrics"] = """
SELECT class, support, hits, coalesce(hits / nullif(CAST(claimed AS DOUBLE), 0), 0) AS precision,
  coalesce(hits / nullif(CAST(support AS DOUBLE), 0), 0) AS recall,
  coalesce(2.0 * hits / nullif(CAST(claimed + support AS DOUBLE), 0), 0) AS f1_score FROM o_class_scores"""
rel.RELATIONS["o_roc_all"] = """
SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg,
  row_number() OVER w AS rn
FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM o_scored GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""
rel.RELATIONS["o_auc"] = """
SELECT (sum(CASE WHEN label = 1 THEN avg_rank END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * CAST(sum(1 - label) AS DOUBLE)) AS roc_auc
FROM (SELECT label, avg(rn) OVER (PARTITION BY score) AS avg_rank
      FROM (SELECT label, score, row_number() OVER (ORDER BY score) AS rn FROM o_scored))"""


def scored(spark: SparkSession, root: str) -> DataFrame:
    bonus = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") < "4"), 300).otherwise(100)
    base = (F.col("o_custkey") * 37 + F.col("o_orderkey") * 11) % 700
    return commerce.read(spark, root, "orders").select(
        "o_orderkey", sem.flag(F.col("o_orderstatus") == "F").alias("label"),
        ((base + bonus).cast("double") / 1000).alias("score"))


def predicted(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.threshold_predictions(scored(spark, root))


_CUSTOMER_KINDS = {"c_custkey": "numeric", "c_name": "text", "c_nationkey": "numeric", "c_acctbal": "numeric",
                   "c_mktsegment": "text"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{kind}' AS kind, count({c}) AS known_rows FROM customer"
                          for c, kind in _CUSTOMER_KINDS.items()))
def feature_types(spark: SparkSession, root: str) -> DataFrame:
    customer = commerce.read(spark, root, "customer")
    text, numeric = features.feature_types(customer)
    known = customer.agg(*[F.count(c).alias(c) for c in (*text, *numeric)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit("text" if c in text else "numeric").alias("kind"),
                     F.col(c).alias("known_rows")) for c in (*text, *numeric)]
    return known.select(F.inline(F.array(*rows)))


@query(f"""
SELECT label, count(*) AS rows, {r('count(*) / CAST(any_value(n) AS DOUBLE)', 'frequency')},
  {r('CAST(any_value(n) AS DOUBLE) / count(*)', 'class_weight')}, {r('any_value(n - p) / CAST(any_value(p) AS DOUBLE)', 'scale_pos_weight')}
FROM o_scored, (SELECT count(*) AS n, sum(label) AS p FROM o_scored) GROUP BY label""")
def class_weights(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.class_weights(scored(spark, root))


@query(f"SELECT o_orderkey, label, {r('score', 'score')}, prediction FROM o_predicted")
def threshold_predictions(spark: SparkSession, root: str) -> DataFrame:
    return predicted(spark, root)


@query("""
SELECT round((SELECT sum(hits) / CAST(sum(support) AS DOUBLE) FROM o_class_metrics), 4) AS accuracy,
  round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score,
  round((SELECT roc_auc FROM o_auc), 4) AS roc_auc
FROM o_class_metrics WHERE class = 1""")
def metrics_summary(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.binary_metrics(scored(spark, root))


@query("SELECT label, prediction, row_count AS rows FROM o_confusion")
def confusion_counts(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.confusion(predicted(spark, root)).select("label", "prediction", "rows")


@query(f"""SELECT label, prediction, {r('row_count / CAST(sum(row_count) OVER (PARTITION BY label) AS DOUBLE)', 'share_of_class')}
FROM o_confusion""")
def confusion_by_class(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.confusion(predicted(spark, root)).select("label", "prediction", "share_of_class")


@query(f"SELECT label, prediction, {r('row_count / CAST(sum(row_count) OVER () AS DOUBLE)', 'share_of_all')} FROM o_confusion")
def confusion_overall(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.confusion(predicted(spark, root)).select("label", "prediction", "share_of_all")


@query(f"""
SELECT CAST(class AS VARCHAR) AS class, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1_score', 'f1_score')},
  CAST(support AS BIGINT) AS support FROM o_class_metrics
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / CAST(sum(support) AS DOUBLE), {DIGITS}), CAST(sum(support) AS BIGINT) FROM o_class_metrics
UNION ALL SELECT 'macro avg', {', '.join(f'round(avg({m}), {DIGITS})' for m in ('precision', 'recall', 'f1_score'))}, CAST(sum(support) AS BIGINT) FROM o_class_metrics
UNION ALL SELECT 'weighted avg', {', '.join(f'round(sum({m} * support) / sum(support), {DIGITS})' for m in ('precision', 'recall', 'f1_score'))},
  CAST(sum(support) AS BIGINT) FROM o_class_metrics""")
def classification_report(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.classification_report(predicted(spark, root))


@query(f"""
SELECT {r('score', 'threshold')}, {r('fp / CAST((SELECT sum(neg) FROM o_roc_all) AS DOUBLE)', 'fpr')},
  {r('tp / CAST((SELECT sum(pos) FROM o_roc_all) AS DOUBLE)', 'tpr')}
FROM o_roc_all WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_points(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.roc_points(scored(spark, root))


@query(f"SELECT {r('roc_auc', 'roc_auc')} FROM o_auc")
def roc_auc_rank(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.roc_auc(scored(spark, root))


@query(f"""
SELECT label, {r("-avg(ln(CASE WHEN label = 1 THEN score ELSE 1 - score END))", "logloss")}, count(*) AS rows
FROM (SELECT label, greatest(least(score, 1 - 1e-15), 1e-15) AS score FROM o_scored) GROUP BY label""")
def logloss_by_class(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.log_loss(scored(spark, root))


# Scores drawn away from one half step by step: the loss falls while they say too little, and rises when they say too much.
_STEPS, _PATIENCE = 60, 5
rel.RELATIONS["o_step_losses"] = f"""
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'validation' ELSE 'train' END AS split, CAST(i AS INTEGER) AS iteration,
  -avg(ln(CASE WHEN label = 1 THEN s ELSE 1 - s END)) AS logloss
FROM (SELECT *, greatest(0.001, least(0.999, 0.5 + (score - 0.5) * i / 20.0)) AS s FROM o_scored, (SELECT unnest(range(0, {_STEPS + 1})) AS i)) GROUP BY ALL"""
rel.RELATIONS["o_step_lows"] = "SELECT *, min(logloss) OVER (PARTITION BY split ORDER BY iteration) AS low FROM o_step_losses"
rel.RELATIONS["o_step_stops"] = f"""
SELECT split, min(iteration) FILTER (iteration - low_at >= {_PATIENCE}) AS stop FROM (
  SELECT *, max(CASE WHEN logloss = low THEN iteration END) OVER (PARTITION BY split ORDER BY iteration) AS low_at
  FROM (SELECT *, row_number() OVER (PARTITION BY split, low ORDER BY iteration) AS k FROM o_step_lows) WHERE logloss > low OR k = 1) GROUP BY 1"""


@query(f"""
SELECT split, min(iteration) AS iteration, {r("min(logloss)", "logloss")} FROM
  (SELECT c.*, min(logloss) OVER (PARTITION BY split) AS best FROM o_step_losses c JOIN o_step_stops USING (split)
   WHERE iteration <= coalesce(stop, 100000))
WHERE logloss = best GROUP BY split""")
def best_iteration_patience(spark: SparkSession, root: str) -> DataFrame:
    """Losses of all scored orders at every step, in one aggregation, and the best step of each split before patience runs out."""
    def loss(i: int) -> Column:
        s = F.greatest(F.lit(0.001), F.least(F.lit(0.999), 0.5 + (F.col("score") - 0.5) * i / 20.0))
        return -F.avg(F.log(F.when(F.col("label") == 1, s).otherwise(1 - s)))
    split = F.when(F.col("o_orderkey") % 3 == 0, "validation").otherwise("train")
    wide = scored(spark, root).groupBy(split.alias("split")).agg(F.array(*[loss(i) for i in range(_STEPS + 1)]).alias("losses"))
    return training.best_iterations(wide.select("split", F.posexplode("losses").alias("iteration", "logloss")), _PATIENCE)


# --- the model: trained as published, checked by rows and invariants -------

_models: dict[tuple, tuple[training.ConversionModel, DataFrame]] = {}


def trained(spark: SparkSession, root: str) -> tuple[training.ConversionModel, DataFrame]:
    """The model and its prepared rows, trained once per session for the same source files."""
    key = (spark.sparkContext.applicationId, *commerce.files(spark, root))
    if key not in _models:
        wide = job(spark, root).wide_features()
        prepared = features.prepare_features(wide, features.new_customer_label(), keep=["device_id", "idprofile"])
        grouped = prepared.withColumn("user", _user()).drop("idprofile")
        rows = materialize(features.assign_split(grouped, "user", 30), "prepared")
        _models[key] = training.train(rows, key="device_id", group="user"), rows
    return _models[key]


@query()
def gbt_train_score(spark: SparkSession, root: str) -> DataFrame:
    model, rows = trained(spark, root)
    return model.score(rows).select("device_id", "split", "label", "score", "prediction")


@query(f"""
SELECT split, label, count(*) AS rows, count(*) AS scores_in_range FROM
  (SELECT CASE WHEN {_BUCKET} < 30 THEN 'validation' ELSE 'train' END AS split,
     CASE WHEN customer_status = 'New Customer' THEN 1 ELSE 0 END AS label FROM ({rel.wide_sql(features.WIDE_COLUMNS)})) GROUP BY ALL""")
def gbt_score_counts(spark: SparkSession, root: str) -> DataFrame:
    model, rows = trained(spark, root)
    inside = F.col("score").between(0, 1) & (F.col("prediction") == sem.flag(F.col("score") > 0.5))
    return model.score(rows).groupBy("split", "label").agg(F.count("*").alias("rows"),
                                                           F.count_if(inside).alias("scores_in_range"))


@query()
def learning_curve(spark: SparkSession, root: str) -> DataFrame:
    model = trained(spark, root)[0]
    return training.learning_curve(model.grown, model.encoded)


@query()
def best_iteration(spark: SparkSession, root: str) -> DataFrame:
    return training.best_iterations(learning_curve(spark, root), training.TrainingParams().patience)


@query()
def feature_importance(spark: SparkSession, root: str) -> DataFrame:
    return training.feature_importance(trained(spark, root)[0])


@query("SELECT 100.0::DOUBLE AS total, CAST(0 AS BIGINT) AS negative")
def feature_importance_total(spark: SparkSession, root: str) -> DataFrame:
    found = training.feature_importance(trained(spark, root)[0])
    return found.agg(F.sum("importance").alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


def _reloaded(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    model, rows = trained(spark, root)
    path = f"{run_folder(spark)}/saved-model-{uuid.uuid4().hex}"
    model.save(path)
    return model.score(rows), training.ConversionModel.load(path).score(rows)


@query()
def model_save_load(spark: SparkSession, root: str) -> DataFrame:
    return _reloaded(spark, root)[1].select("device_id", "score", "prediction")


@query(f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different FROM ({rel.wide_sql(features.WIDE_COLUMNS)})")
def model_save_load_differences(spark: SparkSession, root: str) -> DataFrame:
    before, after = _reloaded(spark, root)
    both = before.select("device_id", F.col("score").alias("was")).join(after.select("device_id", "score"), "device_id", "full")
    return both.agg(F.count("*").alias("rows"), F.count_if(~F.col("was").eqNullSafe(F.col("score"))).alias("different"))


@query()
def shapley_attribution(spark: SparkSession, root: str) -> DataFrame:
    model, rows = trained(spark, root)
    return explain.shapley_summary(explain.shapley_values(model, rows, "device_id"))
