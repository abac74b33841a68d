"""Registered queries of a small model that SQL can train too, by trying all splits on all rows.

Three oblivious trees of three levels learn a planted rule on all orders; its tables, losses, importance and attributions are
compared with SQL that knows nothing of histograms, blocks or tables per leaf.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conversion_engine.functions import semantics as sem
from conversion_engine.ml import explain, oblivious, training
from conversion_engine.plans import commerce
from conversion_engine.plans.queries import DIGITS, query

FEATURES = ("price", "month", "buyer")
TREES, DEPTH, RATE, L2, UNIT = 3, 3, 0.2, 3.0, 1 << 24
#: Cuts of each feature: first, last, step.
CUTS = {"price": (20_000, 480_000, 20_000), "month": (1, 11, 1), "buyer": (4, 44, 5)}


def planted_rows(spark: SparkSession, root: str) -> DataFrame:
    """All orders: a label that dear and summer orders, and some buyers, make likelier; id, features, label, weight, split."""
    key, buyer, month = F.col("o_orderkey"), F.col("o_custkey") % 50, F.month("o_orderdate")
    noise = (key * 7919 + F.col("o_custkey") * 104729) % 1000
    risk = 150 + F.when(F.col("o_totalprice") > 250000, 300).otherwise(0) + F.when(month.between(6, 8), 250).otherwise(0) \
        + F.when(buyer < 15, 200).otherwise(0)
    label = sem.flag(noise < risk)
    return commerce.read(spark, root, "orders").select(
        key.alias("id"), F.col("o_totalprice").alias("price"), month.cast("double").alias("month"), buyer.cast("double").alias("buyer"),
        label.alias("label"), F.when(label == 1, 2.0).otherwise(1.0).alias("weight"),
        F.when((key * 31 + 7) % 10 < 3, "validation").otherwise("train").alias("split"))


_models: dict[tuple, tuple[oblivious.Trees, int, dict[str, list[float]]]] = {}


def planted_model(spark: SparkSession, root: str) -> tuple[oblivious.Trees, DataFrame]:
    rows = planted_rows(spark, root)
    mark = (spark.sparkContext.applicationId, *commerce.files(spark, root))
    if mark not in _models:
        borders = [np.arange(lo, hi + 1, step, float) for lo, hi, step in CUTS.values()]
        _models[mark] = oblivious.fit(rows, list(FEATURES), TREES, learning_rate=RATE, depth=DEPTH, l2=L2, borders=borders)
    return _models[mark][0], rows


def _training_sql() -> str:
    """Relations of the training: rows, cuts, and for each tree and level the best cut and the rows' leaves."""
    cuts = " UNION ALL ".join(f"SELECT {i} AS f, '{name}' AS feature, CAST(unnest(range({lo}, {hi + 1}, {step})) AS DOUBLE) AS border"
                              for i, (name, (lo, hi, step)) in enumerate(CUTS.items()))
    parts = [f"""
plain AS MATERIALIZED (SELECT id, price, month, buyer, label, CASE WHEN label = 1 THEN 2.0 ELSE 1.0 END AS weight, split FROM (
  SELECT o_orderkey AS id, o_totalprice AS price, CAST(month(o_orderdate) AS DOUBLE) AS month, CAST(o_custkey % 50 AS DOUBLE) AS buyer,
    CASE WHEN (o_orderkey * 7919 + o_custkey * 104729) % 1000 < 150 + CASE WHEN o_totalprice > 250000 THEN 300 ELSE 0 END
      + CASE WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 250 ELSE 0 END + CASE WHEN o_custkey % 50 < 15 THEN 200 ELSE 0 END
      THEN 1 ELSE 0 END AS label,
    CASE WHEN (o_orderkey * 31 + 7) % 10 < 3 THEN 'validation' ELSE 'train' END AS split FROM orders)),
cuts AS MATERIALIZED ({cuts}),
long AS MATERIALIZED ({" UNION ALL ".join(f"SELECT id, {i} AS f, {name} AS x FROM plain" for i, name in enumerate(CUTS))}),
m0 AS MATERIALIZED (SELECT id, CAST(0 AS DOUBLE) AS margin FROM plain)"""]
    for t in range(TREES):
        parts.append(f"""
t{t}l0 AS MATERIALIZED (SELECT id, split, 0 AS leaf, round(weight * (label - p) * {UNIT}) AS g, round(weight * p * (1 - p) * {UNIT}) AS h
  FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM plain JOIN m{t} USING (id)))""")
        for level in range(DEPTH):
            parts.append(f"""
t{t}b{level} AS MATERIALIZED (
  SELECT f, feature, border, sum(up * up / (uh + {L2}) + down * down / (dh + {L2}) - (up + down) * (up + down) / (uh + dh + {L2})) AS gain FROM (
    SELECT f, feature, border, leaf, coalesce(sum(g) FILTER (x > border), 0) / {UNIT} AS up, coalesce(sum(h) FILTER (x > border), 0) / {UNIT} AS uh,
      coalesce(sum(g) FILTER (x <= border), 0) / {UNIT} AS down, coalesce(sum(h) FILTER (x <= border), 0) / {UNIT} AS dh
    FROM t{t}l{level} JOIN long USING (id) JOIN cuts USING (f) WHERE split = 'train' GROUP BY ALL)
  GROUP BY ALL ORDER BY gain DESC, f, border LIMIT 1),
t{t}l{level + 1} AS MATERIALIZED (SELECT s.* REPLACE (leaf + CASE WHEN x > border THEN {1 << level} ELSE 0 END AS leaf)
  FROM t{t}l{level} s JOIN long USING (id) JOIN t{t}b{level} USING (f))""")
        parts.append(f"""
v{t} AS MATERIALIZED (SELECT leaf, coalesce({RATE} * sum(g) / {UNIT} / (sum(h) / {UNIT} + {L2}), 0) AS value, coalesce(sum(weight), 0) AS weight
  FROM (SELECT unnest(range({1 << DEPTH})) AS leaf) LEFT JOIN (SELECT s.*, weight FROM t{t}l{DEPTH} s JOIN plain USING (id) WHERE s.split = 'train') USING (leaf)
  GROUP BY leaf),
m{t + 1} AS MATERIALIZED (SELECT id, margin + value AS margin FROM m{t} JOIN t{t}l{DEPTH} USING (id) JOIN v{t} USING (leaf))""")
    union = lambda pick: " UNION ALL ".join(pick(t) for t in range(TREES))
    parts.append(f"""
nodes AS MATERIALIZED ({union(lambda t: " UNION ALL ".join(f"SELECT {t} AS tree, {l} AS level, feature, f, border, gain FROM t{t}b{l}" for l in range(DEPTH)))}),
leaves AS MATERIALIZED ({union(lambda t: f"SELECT {t} AS tree, CAST(leaf AS INTEGER) AS leaf, value, weight FROM v{t}")}),
reached AS MATERIALIZED ({union(lambda t: f"SELECT {t} AS tree, id, leaf FROM t{t}l{DEPTH}")}),
curve AS MATERIALIZED ({union(lambda t: f'''SELECT {t} AS iteration, split,
  sum(weight * ln(1 + exp(CASE WHEN label = 1 THEN -margin ELSE margin END))) / sum(weight) AS logloss FROM plain JOIN m{t + 1} USING (id) GROUP BY split''')})""")
    return "WITH " + ",".join(parts)


def _shapley_sql() -> str:
    """Values of all subsets of features for the rows of each leaf, node by node, and their weighted differences."""
    bit = lambda leaf, level: f"({leaf} // {1 << level}) % 2"
    shares = []
    for level in range(DEPTH):
        node = f"w.leaf % {1 << level} = l.leaf % {1 << level} AND w.tree = l.tree"
        total = f"(SELECT sum(w.weight) FROM leaves w WHERE {node})"
        mine = f"(SELECT sum(w.weight) FROM leaves w WHERE w.leaf % {2 << level} = l.leaf % {2 << level} AND w.tree = l.tree)"
        shares.append(f"(SELECT f FROM nodes n WHERE n.tree = l.tree AND n.level = {level}) AS f{level}, "
                      f"coalesce({mine} / nullif({total}, 0), 0.5) AS s{level}")
    chance = " * ".join(f"CASE WHEN (known // (1 << f{l})) % 2 = 1 THEN CASE WHEN {bit('row_leaf', l)} = {bit('leaf', l)} THEN 1 ELSE 0 END ELSE s{l} END"
                        for l in range(DEPTH))
    n = len(FEATURES)
    terms = []
    for f in range(n):
        others = [g for g in range(n) if g != f]
        for size in range(n):
            for chosen in combinations(others, size):
                without = sum(1 << g for g in chosen)
                weight = factorial(size) * factorial(n - size - 1) / factorial(n)
                terms.append(f"({f}, {without}, {without | 1 << f}, {weight!r})")
    return _training_sql() + f""",
shared AS MATERIALIZED (SELECT l.*, {", ".join(shares)} FROM leaves l),
worth AS MATERIALIZED (SELECT tree, row_leaf, known, sum(value * {chance}) AS v FROM shared,
  (SELECT unnest(range({1 << DEPTH})) AS row_leaf), (SELECT unnest(range({1 << n})) AS known) GROUP BY ALL),
phi AS MATERIALIZED (SELECT a.tree, a.row_leaf AS leaf, k.f, sum(k.weight * (b.v - a.v)) AS value
  FROM (VALUES {", ".join(terms)}) k(f, known, more, weight) JOIN worth a USING (known)
  JOIN worth b ON b.tree = a.tree AND b.row_leaf = a.row_leaf AND b.known = k.more GROUP BY ALL)"""


def r(expr: str, name: str) -> str:
    return f"round({expr}, {DIGITS}) AS {name}"


@query(_training_sql() + f" SELECT tree, level, feature, border, {r('gain', 'gain')} FROM nodes")
def boosted_splits(spark: SparkSession, root: str) -> DataFrame:
    return planted_model(spark, root)[0].nodes(spark)


@query(_training_sql() + f" SELECT tree, leaf, {r('value', 'value')}, CAST(weight AS DOUBLE) AS weight FROM leaves")
def boosted_leaves(spark: SparkSession, root: str) -> DataFrame:
    return planted_model(spark, root)[0].leaves(spark)


@query(_training_sql() + f" SELECT id, {r('1 / (1 + exp(-margin))', 'score')} FROM m{TREES}")
def boosted_scores(spark: SparkSession, root: str) -> DataFrame:
    trees, rows = planted_model(spark, root)
    return rows.select("id", trees.score_column().alias("score"))


@query(_training_sql() + f" SELECT iteration, split, {r('logloss', 'logloss')} FROM curve")
def boosted_learning_curve(spark: SparkSession, root: str) -> DataFrame:
    trees, rows = planted_model(spark, root)
    return training.learning_curve(trees, rows)


@query(_training_sql() + f"""
SELECT split, arg_min(iteration, logloss) AS iteration, {r('min(logloss)', 'logloss')} FROM curve GROUP BY split""")
def boosted_best_iteration(spark: SparkSession, root: str) -> DataFrame:
    trees, rows = planted_model(spark, root)
    return training.best_iterations(training.learning_curve(trees, rows), TREES)


@query(_training_sql() + f""",
paired AS (SELECT n.feature, a.weight * b.weight / (a.weight + b.weight) * (a.value - b.value) * (a.value - b.value) AS change
  FROM nodes n JOIN leaves a ON a.tree = n.tree JOIN leaves b ON b.tree = n.tree AND b.leaf = a.leaf + (1 << n.level)
  WHERE (a.leaf // (1 << n.level)) % 2 = 0 AND a.weight + b.weight > 0),
summed AS (SELECT c.feature, coalesce(sum(change), 0) AS change FROM (SELECT DISTINCT feature FROM cuts) c LEFT JOIN paired USING (feature) GROUP BY 1)
SELECT feature, {r('100 * change / sum(change) OVER ()', 'importance')}, CAST(row_number() OVER (ORDER BY change DESC, feature) AS INTEGER) AS place FROM summed""")
def boosted_importance(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    trees, rows = planted_model(spark, root)
    found = training.importance(trees, encoded=rows.where("split = 'train'"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # a row per feature


@query(_shapley_sql() + f"""
SELECT id, feature, {r('sum(phi.value)', 'value')} FROM reached JOIN phi USING (tree, leaf) JOIN (SELECT DISTINCT f, feature FROM cuts) USING (f) GROUP BY id, feature""")
def boosted_attributions(spark: SparkSession, root: str) -> DataFrame:
    trees, rows = planted_model(spark, root)
    return explain.named(explain.attributions(trees, rows, "id"), "id", list(FEATURES)).drop("base")


@query(f"""
WITH c AS (SELECT o_orderkey, md5('64:' || o_custkey) AS mark, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_orderpriority AS priority,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'COMMON' ELSE CAST(o_custkey % 40 AS VARCHAR) END AS kind FROM orders),
p AS (SELECT avg(label) AS prior FROM c)
SELECT o_orderkey,
  {r('(coalesce(sum(label) OVER a, 0) + prior) / (count(*) OVER a + 1)', 'priority_rate')},
  {r('CASE WHEN kind IS NULL THEN prior ELSE (coalesce(sum(label) OVER b, 0) + prior) / (count(*) OVER b + 1) END', 'kind_rate')}
FROM c, p WINDOW a AS (PARTITION BY priority ORDER BY mark RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP),
  b AS (PARTITION BY kind ORDER BY mark RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)""")
def ordered_category_rates(spark: SparkSession, root: str) -> DataFrame:
    """Every order described by earlier orders of other customers; a third of them share one value."""
    key, buyer = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(key % 7 == 0, None).when(buyer % 3 == 0, "COMMON").otherwise((buyer % 40).cast("string"))
    rows = commerce.read(spark, root, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("priority"), kind.alias("kind"), sem.flag(F.col("o_orderstatus") == "F").alias("label"))
    prior = rows.agg(F.avg("label")).first()[0] or 0.0
    rates = training.ordered_rates(rows, ["priority", "kind"], "label", "o_orderkey", prior, group="o_custkey")
    return rates.select("o_orderkey", F.col("priority__rate").alias("priority_rate"), F.col("kind__rate").alias("kind_rate"))
