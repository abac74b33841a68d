import datetime as dt

from helpers import at, day
from pyspark.sql import functions as F

from conversion_engine.functions import semantics as sem
from conversion_engine.sources.logs import latest_complete_day, read_event_log, release_version


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_day_offset_counts_midnights_not_hours(spark):
    df = spark.createDataFrame([(at(1, 23), at(2, 1)), (at(1, 1), at(1, 23))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(sem.day_offset("b", "a")).collect()] == [1, 0]


def test_least_is_null_when_one_side_is(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(sem.least_strict("a", "b")).collect()] == [None, 1, None]


def test_ratios_with_zero_and_null(spark):
    row = one(spark, sem.div0(F.lit(3), F.lit(0)), sem.div0(F.lit(None), F.lit(0)), sem.div0(F.lit(1), F.lit(4)),
              sem.ratio_or_null(F.lit(3), F.lit(0)))
    assert tuple(row) == (0.0, None, 0.25, None)


def test_weekend(spark):
    df = spark.createDataFrame([(day(n),) for n in range(1, 8)] + [(None,)], "d date")
    assert [r[0] for r in df.select(sem.weekend_flag("d")).collect()] == [0, 0, 0, 0, 0, 1, 1, 0]


def test_bucket_borders(spark):
    offsets = [-1, 0, 1, 2, 5, 6, 13, 14, 20, 21, 28, 29]
    df = spark.createDataFrame([(o, 1) for o in offsets], "o int, n int")
    got = df.agg(*sem.day_buckets(F.col("o"), "n", "x")).first().asDict()
    assert got == {"day0_x": 1, "day1_x": 1, "days2to5_x": 2, "days6to13_x": 2, "days14to20_x": 2,
                   "days21to28_x": 2, "days0to28_x": 10}
    parts = [got[f"{b.name}_x"] for b in sem.DAY_BUCKETS]
    assert sum(parts) == got["days0to28_x"]


def test_bucket_sums_are_null_without_any_value(spark):
    df = spark.createDataFrame([(1, None)], "o int, n int")
    assert set(df.agg(*sem.day_buckets(F.col("o"), "n", "x")).first()) == {None}


def test_json_values_and_their_types(spark):
    rows = [('{"lead": "7", "n": 2, "d": "2024-01-05"}',), ('{"lead": "abc", "n": "x", "d": "soon"}',),
            ('{"lead": null}',), ("not json",), (None,)]
    df = spark.createDataFrame(rows, "j string").select(sem.json_fields("j", ["lead", "n", "d"]).alias("v"))
    got = df.select(sem.typed_text(F.col("v.lead"), "double"), sem.typed_text(F.col("v.n"), "int"),
                    sem.typed_text(F.col("v.d"), "date")).collect()
    assert [tuple(r) for r in got] == [(7.0, 2, dt.date(2024, 1, 5))] + [(None, None, None)] * 4


def test_missing_version_is_not_released(spark):
    df = spark.createDataFrame([("1.0",), ("2-STAGING",), (None,)], "v string")
    assert [r.v for r in df.where(release_version(F.col("v"))).collect()] == ["1.0"]


def test_log_range_is_by_calendar_day_whatever_the_suffix(spark):
    texts = ["2023-12-31T23:59:59Z", "2024-01-01T00:00:00Z", "2024-01-02T23:59:59.5+09:00", "2024-01-03T00:00:00Z", "bad"]
    log = spark.createDataFrame([("INSTALL", t) for t in texts] + [("OPEN", texts[1])], "name string, timestamp_iso string")
    got = read_event_log(log, ["INSTALL"], day(1), day(2))
    assert sorted(r.timestamp_iso for r in got.collect()) == texts[1:3]


def test_data_lag():
    assert latest_complete_day("2024-02-01") == dt.date(2024, 1, 30)
