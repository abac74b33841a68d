"""Days added one by one give the same analysis as the whole log, and leave other days' files alone."""

import datetime as dt
import pathlib

import pytest
from helpers import records
from pyspark.sql import functions as F

from conversion_engine.operators import funnel
from conversion_engine.plans import commerce
from conversion_engine.plans.conversion import ConversionJob, ConversionTables
from conversion_engine.plans.day_state import DayState, IncrementalJob, write_report
from conversion_engine.sources import logs
from conversion_engine.sources.schemas import SCHEMAS

ROOT = "/root/testdata/sf0.001"
SCHEMA = "event_date date, k int, v string"


def rows(spark, *values):
    return spark.createDataFrame([(dt.date(2024, 1, d), k, v) for d, k, v in values], SCHEMA)


def files(path):
    return {p: p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def test_replaced_days_leave_the_others_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    first = rows(spark, (1, 1, "a"), (2, 2, "b"), (2, 3, "c"), (3, 4, "d"), (9, 9, "not asked for"))
    logs.replace_days(first, path, ["2024-01-01", "2024-01-02", "2024-01-03"])
    before = files(path)
    read = lambda: sorted((r.event_date.day, r.k, r.v) for r in logs.read_days(spark, path, first.schema).collect())
    assert read() == [(1, 1, "a"), (2, 2, "b"), (2, 3, "c"), (3, 4, "d")]
    for _ in range(2):  # a rerun gives the same table
        logs.replace_days(rows(spark, (2, 5, "new")), path, ["2024-01-02"])
        assert read() == [(1, 1, "a"), (2, 5, "new"), (3, 4, "d")]
    after = files(path)
    assert {p: t for p, t in before.items() if "event_date=2024-01-02" not in str(p)}.items() <= after.items()
    logs.replace_days(rows(spark), path, ["2024-01-03"])  # a day that has no rows any more
    assert read() == [(1, 1, "a"), (2, 5, "new")]
    assert not [p for p in pathlib.Path(path).iterdir() if p.name.startswith("_stage")]


def test_a_run_that_broke_off_is_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    logs.replace_days(rows(spark, (1, 1, "a"), (2, 2, "b")), path, ["2024-01-01", "2024-01-02"])
    broken = rows(spark, (1, 7, "x"), (2, 8, "y")).withColumn("v", F.when(F.col("k") == 8, F.raise_error("lost")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        logs.replace_days(broken, path, ["2024-01-01", "2024-01-02"])
    kept = logs.read_days(spark, path, rows(spark).schema)
    assert sorted((r.event_date.day, r.k) for r in kept.collect()) == [(1, 1), (2, 2)]
    logs.replace_days(rows(spark, (1, 7, "x")), path, ["2024-01-01", "2024-01-02"])
    assert [(r.event_date.day, r.k) for r in logs.read_days(spark, path, rows(spark).schema).collect()] == [(1, 7)]


def test_empty_table(spark, tmp_path):
    assert logs.read_days(spark, str(tmp_path / "none"), rows(spark).schema).count() == 0


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    if not pathlib.Path(ROOT).exists():
        pytest.skip("test data is not here")
    folder = str(tmp_path_factory.mktemp("domain"))
    derived = commerce.tables(spark, ROOT)
    for name in SCHEMAS:
        logs.write_table(getattr(derived, name), f"{folder}/{name}", ["event_date"] if name == "event_log" else [])
    return ConversionTables.read(spark, folder)


@pytest.fixture(scope="module")
def state(spark, source, tmp_path_factory):
    made = DayState(spark, str(tmp_path_factory.mktemp("state")))
    for i in range(1, 28):
        day = dt.date(2024, 1, i)
        # A run sees its own day of the log and nothing else.
        made.add(source.event_log.where(F.col("event_date") == F.lit(day)), day)
    return made


def test_single_days_give_the_wide_table_of_one_run(source, state, tmp_path):
    once = records(ConversionJob(source, commerce.PERIOD).wide_features(), "device_id")
    wide = IncrementalJob(source, commerce.PERIOD, state).wide_features()
    daily = records(wide, "device_id")
    assert once and len(daily) == len(once)
    for a, b in zip(once, daily):
        assert a == {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in b.items()}
    path = str(tmp_path / "report")
    days = sorted({r["install_date"] for r in once})
    write_report(wide, path, days)
    before = files(path)
    write_report(wide, path, days[:1])
    assert {p for p in before if f"install_date={days[0]}" not in str(p)} < set(files(path))
    assert len(records(logs.read_days(wide.sparkSession, path, wide.schema, by="install_date"))) == len(once)


def test_every_funnel_of_the_state_is_that_of_the_log(source, state):
    plain, kept = ConversionJob(source, commerce.PERIOD), IncrementalJob(source, commerce.PERIOD, state)
    for name in ("search_steps", "property_views", "property_actions", "checkout_steps"):
        a, b = (records(j.funnel_days([name])) for j in (plain, kept))
        assert a and [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for r in a] == \
            [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for r in b]
    assert records(plain.user_map) == records(kept.user_map)
    assert records(plain.earliest_usage()) == records(kept.earliest_usage())


def test_a_day_is_read_alone_and_put_in_place_of_itself(spark, source, state):
    plan = logs.normalize_events(source.event_log, "2024-01-05", "2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-05" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    before, rows_before = files(state.path), records(state.table("funnels", dt.date(2024, 1, 1), dt.date(2024, 1, 31)))
    state.add(source.event_log, "2024-01-05")
    after = files(state.path)
    gone = {p for p in before if p not in after}
    assert gone and all("event_date=2024-01-05" in str(p) for p in gone)
    assert rows_before == records(state.table("funnels", dt.date(2024, 1, 1), dt.date(2024, 1, 31)))


def test_missing_days_are_named(spark, source, tmp_path):
    with pytest.raises(ValueError, match="2024-01-03"):
        IncrementalJob(source, commerce.PERIOD, DayState(spark, str(tmp_path / "s")))


def test_raw_filter_keeps_escaped_letters(spark):
    specs = funnel.count_specs()
    keep = funnel.event_filter([*specs.values(), funnel.search_spec()])
    df = spark.createDataFrame([("x", '{"action": "Search Submitted"}'), ("x", '{"action": "\\u0053earch Submitted"}'), ("x", '{"action": "other"}'),
                                ("x", None), ("BEGIN_CHECKOUT", "{}"), ("begin_checkout", None)], "event_name string, event_parameters string")
    assert [r.event_name for r in df.where(keep).collect()] == ["x", "x", "BEGIN_CHECKOUT", "begin_checkout"]
    assert funnel.event_filter([specs["linkups"]]) is not None


def test_files_of_a_day_do_not_grow_with_tasks(spark, tmp_path):
    days = [dt.date(2024, 1, 1 + i) for i in range(3)]
    rows = spark.createDataFrame([(days[i % 3], i) for i in range(300)], "event_date date, n int").repartition(7)
    logs.replace_days(rows, f"{tmp_path}/t", days)
    for d in days:
        assert len(list((tmp_path / "t" / f"event_date={d}").glob("*.parquet"))) == 1
    assert logs.read_days(spark, f"{tmp_path}/t", rows.schema).agg({"n": "sum"}).first()[0] == 300 * 299 // 2


def test_parameters_that_a_log_builds_are_built_once(spark, tmp_path):
    """The raw test of the funnels looks at the parameters once per text; a log that derives them must not derive them as often."""
    schema = "event_date date, event_name string, platform string, profile_id string, user_pseudo_id string, a string, u string, v string"
    row = (dt.date(2024, 1, 3), "Search_Event", "iOS", "1", "p", "Search Submitted", "x", "15.2")
    spark.createDataFrame([row, (*row[:5], "Other", "x", "15.2")], schema).write.parquet(f"{tmp_path}/raw")
    made = [F.to_json(F.struct(F.col("a").alias("action"), F.lit("Spain").alias("destination_country"))).alias("event_parameters"),
            F.format_string('{"userId": "%s"}', "u").alias("user_properties"), F.format_string('{"version": "%s"}', "v").alias("app_info")]
    log = spark.read.parquet(f"{tmp_path}/raw").select("event_date", "event_name", "platform", "profile_id", "user_pseudo_id", *made)
    job = ConversionJob(ConversionTables(event_log=log, **{n: None for n in SCHEMAS if n != "event_log"}), commerce.PERIOD)
    counted = job.funnel_partials([funnel.count_specs()["search_steps"]], funnel.search_spec())
    assert [r["searches_submitted"] for r in funnel.merged_days(counted, [], None, funnel.search_spec(), lambda d: d.withColumn(
        "copies", F.lit(1).cast("bigint")).withColumn("trip", F.lit("domestic"))).collect()] == [1]
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Spain") == 1  # the text of the derived parameters
