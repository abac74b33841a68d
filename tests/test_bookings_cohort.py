import random

from helpers import at, day, records
from pyspark.sql import functions as F

from conversion_engine.operators import bookings as bk
from conversion_engine.operators import cohort as co
from conversion_engine.operators import joins
from conversion_engine.session import materialize

INSTALLS = "device_id string, profile_id bigint, install_date date, install_timestamp timestamp_ntz"
STAR = ("id_profile bigint, id_customer bigint, id_date_first_booking date, id_first_booking bigint, id_booking bigint, "
        "booked timestamp_ntz, booked_date date, arrival_date date, departure_date date, booking_platform string")


def install(device, profile, n, hour=12):
    return device, profile, day(n), at(n, hour)


def booking(i, profile, customer, first, n, hour=12, arrival=3):
    return profile, customer, first, i, i, at(n, hour), day(n), day(n + arrival), day(n + arrival + 2), "APP"


def both(spark, installs, star):
    installs = materialize(spark.createDataFrame(installs, INSTALLS), "installs")
    reached = materialize(bk.bookings_after_first_install(installs, spark.createDataFrame(star, STAR)), "reached")
    return bk.attach_bookings(installs, reached), bk.booking_summary(installs, reached)


def test_offsets_status_and_pending_trips(spark):
    installs = [install("d", 1, 5), install("none", None, 5), install("idle", 9, 5)]
    offsets = [0, 1, 2, 5, 6, 13, 14, 20, 21, 28, 29]
    star = [booking(i, 1, 7, day(5), 5 + o, 13) for i, o in enumerate(offsets)]
    star += [booking(90, 1, 7, day(5), 5, 11, 10), booking(91, 1, 7, day(5), 4, 23)]
    level, summary = both(spark, installs, star)
    rows = {r.id_booking: r for r in level.where(F.col("device_id") == "d").collect()}
    assert 91 not in rows, "a booking of the day before is not joined"
    flags = {name: sum(getattr(rows[i], f"{name}_app_bookings") for i in rows) for name in
             ("day0", "day1", "days2to5", "days6to13", "days14to20", "days21to28", "days0to28")}
    assert flags == {"day0": 1, "day1": 1, "days2to5": 2, "days6to13": 2, "days14to20": 2, "days21to28": 2, "days0to28": 10}
    assert rows[90].days0to28_app_bookings == 0, "booked on the install day, before the install"
    assert rows[90].days_to_app_booking_post_install is None and rows[90].trip_pending_yn == 1
    assert rows[1].days_to_app_booking_post_install == 1 and rows[1].trip_pending_yn == 0
    assert {r.customer_status for r in rows.values()} == {"Existing Customer"}
    got = {r.device_id: (r.owners, r.customer_status, r.days0to28_app_bookings) for r in summary.collect()}
    assert got == {"d": (1, "Existing Customer", 10), "none": (0, "Not a Customer", 0), "idle": (0, "Not a Customer", 0)}


def test_statuses(spark):
    installs = [install("new", 1, 5), install("old", 2, 5), install("before", 3, 5), install("midnight", 4, 5, 23)]
    star = [booking(1, 1, 1, day(6), 6), booking(2, 2, 2, day(4), 6), booking(3, 3, 3, day(2), 2),
            booking(4, 4, 4, day(6), 6, 1)]
    _, summary = both(spark, installs, star)
    got = {r.device_id: (r.customer_status, r.days0to28_app_bookings) for r in summary.collect()}
    # All bookings of "before" precede its install: none is joined.
    assert got == {"new": ("New Customer", 1), "old": ("Existing Customer", 1), "before": ("Not a Customer", 0),
                   "midnight": ("New Customer", 1)}


def test_two_customers_on_a_device(spark):
    _, summary = both(spark, [install("d", 1, 5)], [booking(1, 1, 10, day(6), 6), booking(2, 1, 11, day(6), 7)])
    assert summary.first().owners == 2


def test_summary_agrees_with_pairs_for_a_hot_profile(spark):
    rng = random.Random(5)
    installs = [install(f"hot{i}", 1, rng.randint(1, 8), rng.randint(0, 23)) for i in range(60)]
    installs += [install(f"d{i}", rng.choice([2, 3, None]), rng.randint(1, 8), rng.randint(0, 23)) for i in range(40)]
    star = [booking(i, rng.choice([1, 1, 2, 3]), None, day(rng.randint(1, 9)), rng.randint(1, 40), rng.randint(0, 23))
            for i in range(150)]
    star = [(b[0], b[0] * 10, day(4), *b[3:]) for b in star]
    level, summary = both(spark, installs, star)
    expected = {r.device_id: tuple(r)[1:] for r in level.groupBy("device_id").agg(
        F.count_distinct("id_customer"), F.max("customer_status"), F.sum("days0to28_app_bookings"), F.min("first_booked_date")
    ).collect()}
    got = {r.device_id: (r.owners, r.customer_status, r.days0to28_app_bookings, r.first_booked_date) for r in summary.collect()}
    assert got == expected


def test_star_filters(spark):
    good = (1, 5, 100, 1, at(3), day(3), day(5), day(7), 1, 1, 1, 2)
    names = ["id_booking", "id_profile", "id_customer", "id_site_name", "booked", "booked_date", "arrival_date",
             "departure_date", "id_booking_status", "id_booking_type", "id_site_type", "bednights"]
    changes = [{}, {"id_booking_status": 3}, {"id_booking_type": 2}, {"id_site_type": 33}, {"bednights": 0},
               {"id_site_name": 2}, {"id_customer": 101}, {"id_customer": 102}, {"booked_date": day(20)}]
    rows = [tuple({**dict(zip(names, good)), "id_booking": i, **c}.values()) for i, c in enumerate(changes)]
    rows.append(tuple({**dict(zip(names, good)), "id_booking": 50}.values()))
    from conversion_engine.sources.schemas import SCHEMAS
    star = bk.booking_star(
        spark.createDataFrame(rows, SCHEMAS["booking"]),
        spark.createDataFrame([(i, "APP") for i in range(len(changes))] + [(50, "WEB")], SCHEMAS["booking_attribution"]),
        spark.createDataFrame([(100, day(3), 1), (101, None, None), (102, day(9), 1)], SCHEMAS["customer"]),
        spark.createDataFrame([(1, "MAIN"), (2, "OTHER")], SCHEMAS["site"]),
        spark.createDataFrame([(day(3), 2024, 1, "Jan")], SCHEMAS["calendar"]),
        bk.BookingFilters(day(1), day(10), "MAIN"))
    assert [r.id_booking for r in star.collect()] == [0]


def test_latest_record_keeps_ties_once(spark):
    df = spark.createDataFrame([(1, day(1), 1), (1, day(3), 0), (1, day(3), 1), (1, day(3), 1), (2, day(1), 0)],
                               "k int, d date, v int")
    assert [tuple(r) for r in sorted(co.latest_record(df, "k", "d", ["v"]).collect())] == [
        (1, day(3), 0), (1, day(3), 1), (2, day(1), 0)]
    push = spark.createDataFrame([(1, day(1), "TRUE"), (1, day(3), "FALSE"), (1, day(3), "TRUE"), (2, day(1), "FALSE"), (2, day(1), "FALSE")],
                                 "id_profile bigint, date_push date, push_opt_in string")
    got = {r.id_profile: (r.date_push, r.push_yn, r.push_states) for r in co.current_push_status(push).collect()}
    assert got == {1: (day(3), 1, 2), 2: (day(1), 0, 1)}


DEVICES = (INSTALLS + ", platform string, install_source string, install_source_detail string, ip_country string, "
           "ip_region string, brand string, owners int, first_booked_date date, customer_status string, days0to28_app_bookings bigint")


def test_install_cohort_drops_shared_devices_and_undated_installs(spark):
    def device(name, profile, n, owners=0):
        return (*install(name, profile, n), "IOS", "a", "b", "c", "r", "x", owners, None, "New Customer", 3)

    devices = spark.createDataFrame([device("sat", 1, 6), device("shared", 1, 6, 2), device("gap", 1, 7), device("late", 1, 30),
                                     device("anon", None, 8)], DEVICES)
    calendar = spark.createDataFrame([(day(n),) for n in (6, 8, 30)], "iddate date")
    push = spark.createDataFrame([(1, day(3), "FALSE"), (1, day(3), "TRUE")], "id_profile bigint, date_push date, push_opt_in string")
    plain = records(co.install_cohort(devices, calendar, push, day(1), day(20)), "device_id")
    assert [(r["device_id"], r["installed_on_weekend"], r["push_yn"], r["profile_created_yn"], r["days0to28_app_bookings"])
            for r in plain] == [("anon", 0, 0, 0, 3), ("sat", 1, 1, 1, 3)]
    parity = records(co.install_cohort(devices, calendar, push, day(1), day(20), parity=True), "device_id")
    assert [r["days0to28_app_bookings"] for r in parity] == [3, 6]


def test_eligibility_borders(spark):
    rows = [("none", None, "Not a Customer", 0, 1, True), ("m1", day(9), "Not a Customer", 0, 1, False),
            ("d0", day(10), "Not a Customer", 0, 1, True), ("d28", day(38), "Not a Customer", 0, 1, True),
            ("d29", day(39), "Not a Customer", 0, 1, False), ("new", None, "New Customer", 1, 1, True),
            ("new0", None, "New Customer", 0, 1, False), ("old", None, "Existing Customer", 4, 1, False),
            ("anon", None, "Not a Customer", 0, 0, False), ("unknown", None, None, 1, 1, False)]
    df = spark.createDataFrame([(*r[:5], day(10)) for r in rows],
                               "n string, earliest_app_usage date, customer_status string, days0to28_app_bookings int, "
                               "profile_created_yn int, install_date date")
    assert {r.n for r in df.where(co.eligible()).collect()} == {r[0] for r in rows if r[5]}


def test_earliest_usage_by_platform_and_version(spark):
    def event(n, platform, version, profile="p"):
        info = None if version is None else f'{{"version": "{version}"}}'
        return day(n), platform, profile, info

    events = spark.createDataFrame(
        [event(9, "iOS", "12.1"), event(4, "IOS", "13.0"), event(2, "android", "12.1"), event(3, "ios", "12.0-Staging"),
         event(1, "ios", None), event(5, "Android", "9.9", "q"), event(1, "web", "9.9", "q"), event(30, "ios", "12", "late")],
        "event_date date, platform string, profile_id string, app_info string")
    got = {r.profile_id: r.earliest_app_usage for r in co.earliest_usage(events, day(1), day(20)).collect()}
    assert got == {"p": day(4), "q": day(5)}


def test_missing_keys_are_spread_and_match_nothing(spark):
    left = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 5, F.col("id")).alias("k"))
    spread = left.select(joins.spread_key("k", ["id"]).alias("s")).distinct().count()
    assert spread == 2000
    right = spark.createDataFrame([(0, "a"), (4, "b"), (None, "x")], "r bigint, v string")
    got = joins.left_join_sparse(left, right, "k", "r", ["id"])
    assert got.count() == 2000 and sorted(r.v for r in got.where("v is not null").collect()) == ["a", "b"]


def test_month_bounds(spark):
    calendar = spark.createDataFrame([(d, d.year, d.month) for d in (day(3), day(20), day(40))], "iddate date, idyear int, idmonth int")
    got = {r.iddate: (r.month_start_date, r.month_end_date) for r in joins.month_bounds(calendar).collect()}
    assert got == {day(3): (day(3), day(20)), day(20): (day(3), day(20)), day(40): (day(40), day(40))}


def test_earlier_use_parses_each_row_once(spark, tmp_path):
    rows = [(day(1), "iOS", "1", '{"version": "12.4"}'), (day(1), "Android", "2", '{"version": "15.2"}'), (day(2), "iOS", "1", None)]
    spark.createDataFrame(rows, "event_date date, platform string, profile_id string, app_info string").write.parquet(f"{tmp_path}/log")
    used = co.earliest_usage(spark.read.parquet(f"{tmp_path}/log"), day(1), day(9))
    assert [tuple(r) for r in used.collect()] == [("1", day(1))]
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
