import pathlib
import re

import pytest
from helpers import records

from conversion_engine.plans import commerce
from conversion_engine.plans.conversion import ConversionJob, ProfileBuckets
from conversion_engine.session import store_bucketed

ROOT = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.split("== Initial Plan ==")[0])


@pytest.mark.skipif(not pathlib.Path(ROOT).exists(), reason="test data is not here")
def test_stored_by_profile_nothing_is_exchanged_and_nothing_changes(spark, no_broadcast):
    job = ConversionJob(commerce.tables(spark, ROOT), commerce.PERIOD)
    buckets = ProfileBuckets(job, 4)
    wide, windows = buckets.wide(), buckets.windows(["property_views", "search"], 0, 6)
    assert exchanges(wide) == [] and exchanges(windows) == []
    plain = records(job.wide_features(), "device_id")
    assert plain and [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for r in plain] == \
        [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for r in records(wide, "device_id")]
    assert len(exchanges(job.wide_features())) > 4


def test_buckets_hold_all_rows(spark, no_broadcast):
    left = spark.range(500).selectExpr("id % 37 AS k", "id")
    a, b = store_bucketed(left, "left", "k", 3), store_bucketed(left.limit(0), "none", "k", 3)
    assert sorted(a.collect()) == sorted(left.collect()) and b.count() == 0
    counts = a.join(b, "k", "left").groupBy("k").count()
    assert exchanges(counts) == [] and counts.count() == 37
