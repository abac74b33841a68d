"""The operators on their whole tables, as registered queries.

``SPARK`` maps a name to a function of (spark, folder); ``ORACLE`` holds DuckDB SQL
where SQL can express the operator.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conversion_engine.llm import (caps, centroids, common, host_rules, line_dedup, mixing, ngram_join, order_minhash,
                                   packing, pii, quality_crf, spelling, substrings, toxicity)
from conversion_engine.llm.labels import held_out

Query = Callable[[SparkSession, str], DataFrame]
SPARK: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    SPARK[fn.__name__] = fn
    return fn


def tokenizer() -> dict[str, str]:
    """The vocabulary of ``byte_bpe_50k.json`` as ranks, and the pattern of its pieces."""
    import public_tokenizers

    return {"ranks_path": str(public_tokenizers.path("byte_bpe_50k.tiktoken")), "pattern": public_tokenizers.PATTERN}


@query
def op8_pack_sequences(spark: SparkSession, root: str) -> DataFrame:
    pieces = packing.pack(common.documents(spark, root), **tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query
def op7_find_personal_data(spark: SparkSession, root: str) -> DataFrame:
    found = pii.detect(common.documents(spark, root))
    plain = F.filter("spans", lambda s: s["plain"])

    def count(kind: str) -> Column:
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.written(plain), 256).alias("base_sha256"),
                        pii.written("spans").alias("spans"))


@query
def op10_host_rules(spark: SparkSession, root: str) -> DataFrame:
    return host_rules.judge(common.documents(spark, root)).select(
        "doc_id", *host_rules.METRICS, "base_failed", "kept")


ORACLE["op10_host_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars AS failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS k FROM f WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT count(*) AS hosts, sum(n) AS n, sum(k) / sum(n) AS mean, sum(k * k / n) AS q FROM h),
e AS (SELECT *, q / n - mean * mean - mean * (1 - mean) * hosts / n AS extra FROM t),
s AS (SELECT mean, greatest(1.0, least(n, CASE WHEN extra > 0 THEN mean * (1 - mean) / extra - 1 ELSE n END)) AS strength
      FROM e),
v AS (SELECT source, (h.k + mean * strength) / (h.n + strength) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN v USING (source)
"""


@query
def op5_dedup_lines(spark: SparkSession, root: str) -> DataFrame:
    return line_dedup.dedup_lines(common.documents(spark, root)).select(
        "doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("text_sha256"))


ORACLE["op5_dedup_lines"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
n AS (SELECT *, len(ws) AS n, array_to_string(ws, ' ') AS norm FROM w),
f AS (SELECT *, n = 0 OR row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) = 1 AS first FROM n),
c AS (SELECT doc_id, i, n, norm, ws FROM f WHERE first AND n >= 9),
v AS (SELECT doc_id, i, n, p, array_to_string(list_concat(ws[:p - 1], ws[p + 1:]), ' ') AS v
      FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM c)),
near AS (
  SELECT a.doc_id, a.i FROM v a JOIN v b ON a.v = b.v AND a.n = b.n AND a.p = b.p AND (b.doc_id, b.i) < (a.doc_id, a.i)
  UNION SELECT a.doc_id, a.i FROM v a JOIN c b ON a.v = b.norm AND a.n = b.n + 1 AND (b.doc_id, b.i) < (a.doc_id, a.i)
  UNION SELECT a.doc_id, a.i FROM c a JOIN v b ON a.norm = b.v AND b.n = a.n + 1 AND (b.doc_id, b.i) < (a.doc_id, a.i)),
k AS (SELECT f.*, near.i IS NOT NULL AS near FROM f LEFT JOIN near ON f.doc_id = near.doc_id AND f.i = near.i),
t AS (SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (NOT first))::BIGINT AS n_exact,
             (count(*) FILTER (near))::BIGINT AS n_near,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (first AND NOT near), '')) AS text_sha256
      FROM k GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
       text_sha256 FROM documents LEFT JOIN t USING (doc_id)
"""


@query
def op6_dedup_substrings(spark: SparkSession, root: str) -> DataFrame:
    return substrings.dedup_substrings(common.documents(spark, root)).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op6_dedup_substrings"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                      lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
o AS (SELECT doc_id, word, p FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w)
      ANTI JOIN c USING (doc_id, p)),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM o GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


@query
def op9_mix_sources(spark: SparkSession, root: str) -> DataFrame:
    docs = common.documents(spark, root)
    # Unequal targets: the square root of a source's rows, times one to four by its name.
    weights = {s: w * (1 + crc32((s or "").encode()) % 4) for s, w in mixing.temperature_weights(docs).items()}
    return mixing.mix(docs, weights).select("doc_id", "source", "rank", "slot", "phase")


@query
def op2_ngram_jaccard(spark: SparkSession, root: str) -> DataFrame:
    return ngram_join.jaccard_components(common.documents(spark, root)).select("doc_id", "n_shingles", "component_id")


@query
def op1_cap_filters(spark: SparkSession, root: str) -> DataFrame:
    return caps.near_vectors(spark.read.parquet(f"{root}/embeddings.parquet"))


@query
def op3_line_field_quality(spark: SparkSession, root: str) -> DataFrame:
    docs = common.documents(spark, root)
    model = quality_crf.train(docs, spark.read.parquet(f"{root}/labels.parquet"))
    return quality_crf.score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = common.documents(spark, root)
    model = toxicity.train(docs, spark.read.parquet(f"{root}/labels.parquet"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_ns_centroids(spark: SparkSession, root: str) -> DataFrame:
    return centroids.cluster_vectors(spark.read.parquet(f"{root}/embeddings.parquet"))


def _lloyd_sql(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    """Lloyd's rounds without bounds: all distances in every round."""
    def assigned(t: int) -> str:
        return f"""
a{t} AS MATERIALIZED (SELECT vec_id, min((d, j)) AS best FROM (
  SELECT vec_id, j, sum((x - c) * (x - c)) AS d FROM p JOIN c{t} USING (i) GROUP BY 1, 2) GROUP BY 1)"""

    def moved(t: int) -> str:
        return f"""
s{t} AS (SELECT best[2] AS j, i, sum(x) AS s, count(*) AS n FROM p JOIN a{t} USING (vec_id) GROUP BY 1, 2),
c{t + 1} AS MATERIALIZED (SELECT j, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{t} LEFT JOIN s{t} USING (j, i))"""

    steps = [assigned(0)]
    for t in range(rounds):
        steps += [moved(t), assigned(t + 1)]
    return f"""
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {width}
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, unnest(range(1, {width + 1})) AS i, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM v),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j FROM v),
c0 AS MATERIALIZED (SELECT j, i, x AS c FROM f JOIN p USING (vec_id) WHERE j < {k}),{",".join(steps)},
h AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
  CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
  centroid_sha256 FROM a{rounds} JOIN h ON h.j = best[2]
"""


ORACLE["op11_ns_centroids"] = _lloyd_sql()


@query
def op12_order_minhash(spark: SparkSession, root: str) -> DataFrame:
    return order_minhash.fingerprints(common.documents(spark, root))


@query
def op13_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    return spelling.spelling_variants(common.documents(spark, root))
