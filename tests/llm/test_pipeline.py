import pathlib

import pytest
from helpers_llm import documents, table
from oracle_check import compare, connect

import corpus_pipeline
from conversion_engine.llm import mixing, queries

ROOT = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not pathlib.Path(ROOT).exists(), reason="test data is not here")


@data
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, ROOT, connect(ROOT), queries.SPARK[name], queries.ORACLE[name]) is None


def test_stages(spark):
    rows = [r for r in documents() if r[0] not in (None, 15)]
    docs, kinds = table(spark, rows), table(spark, rows).schema
    stages = dict(corpus_pipeline.STAGES)
    cut = stages["lines"](spark, docs, "")
    assert [f.dataType for f in cut.schema] == [f.dataType for f in kinds] and cut.columns == docs.columns
    left = {r["doc_id"]: r for r in cut.collect()}
    assert 1 in left and 2 not in left and 7 not in left and all(r["n_chars"] == len(r["text"]) for r in left.values())
    one = stages["near_duplicates"](spark, docs, "")
    assert one.where("doc_id IN (1, 2, 3)").count() == 1
    mixed = stages["mixture"](spark, docs, "")
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))


def test_sequences_follow_the_slots(spark, tmp_path):
    rows = [(i, "word " * (5 + i % 7), None, f"s{i % 3}", 0) for i in range(120)]
    rows += [(1000 + i, "other word " * 40 + str(i), None, "hot", 0) for i in range(400)]
    stages, docs = dict(corpus_pipeline.STAGES), table(spark, rows)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        stages["mixture"](spark, docs, "").write.parquet(f"{tmp_path}/mixture")
    finally:
        spark.conf.set(setting, before)
    sizes = [f.stat().st_size for f in sorted(tmp_path.glob("mixture/*.parquet"))]
    assert len(sizes) > 2 and sizes != sorted(sizes, reverse=True)  # a scan begins with the largest file
    packed = stages["pack"](spark, spark.read.schema(docs.schema).parquet(f"{tmp_path}/mixture"), "")
    pieces = packed.where("start = 0").orderBy("sequence_id", "offset").collect()
    mixed = mixing.mix(docs)
    rank, slot, _ = mixed.columns[-3:]
    assert [r["doc_id"] for r in pieces] == [r["doc_id"] for r in mixed.orderBy(slot, rank).collect()]


@data
def test_run(spark):
    pieces = corpus_pipeline.run(spark, ROOT)
    totals = {r["doc_id"]: (r["n"], r["t"]) for r in pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"})
              .toDF("doc_id", "n", "t").collect()}
    assert totals and all(n == t for n, t in totals.values())
    assert len(totals) < spark.read.parquet(f"{ROOT}/documents.parquet").count()
