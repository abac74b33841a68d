"""Gradient-boosted training with class weights, category encoding and early stopping."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conversion_engine.ml import oblivious
from conversion_engine.operators.features import feature_types, split_bucket
from conversion_engine.operators.joins import left_join_sparse
from conversion_engine.session import materialize


@dataclass(frozen=True)
class TrainingParams:
    """The settings of the original training run."""

    iterations: int = 1200
    learning_rate: float = 0.2
    depth: int = 6
    seed: int = 64
    patience: int = 50
    max_bins: int = 255
    l2: float = 3.0
    prior_weight: float = 1.0
    weighting: str = "scale_pos_weight"


@dataclass
class CategoryStatistics:
    """Label statistics of one text column: positives and rows per value and fold."""

    column: str
    table: DataFrame
    prior: float
    prior_weight: float

    @property
    def output(self) -> str:
        return f"{self.column}__rate"

    def _smoothed(self, positives: Column, rows: Column) -> Column:
        return (positives + self.prior * self.prior_weight) / (rows + self.prior_weight)

    def _joined(self, df: DataFrame, rates: DataFrame, key: Column, spread_by: list[str]) -> DataFrame:
        """NULLs, which no rate describes, and values without a rate get the overall share."""
        joined = left_join_sparse(df, rates, key, "__value", spread_by or [self.column])
        return joined.withColumn(self.output, F.coalesce(self.output, F.lit(self.prior)))

    def encode(self, df: DataFrame, spread_by: list[str] = ()) -> DataFrame:
        """Smoothed share of positives per value. ``spread_by`` tells rows with a NULL apart."""
        totals = self.table.groupBy(self.column).agg(F.sum("positives").alias("p"), F.sum("rows").alias("n"))
        rates = totals.select(F.col(self.column).alias("__value"),
                              self._smoothed(F.col("p"), F.col("n")).alias(self.output))
        return self._joined(df, rates, F.col(self.column), list(spread_by))

    def encode_out_of_fold(self, df: DataFrame, spread_by: list[str] = (), fold: str = "fold") -> DataFrame:
        """As ``encode``, but each row is described by the other folds only."""
        totals = self.table.groupBy(self.column).agg(F.sum("positives").alias("p"), F.sum("rows").alias("n"))
        def key(f: str) -> Column:
            return F.concat(F.col(f).cast("string"), F.lit("\u0002"), F.col(self.column))
        others = self.table.join(totals, self.column).select(
            key("fold").alias("__value"),
            self._smoothed(F.col("p") - F.col("positives"), F.col("n") - F.col("rows")).alias(self.output))
        return self._joined(df, others, key(fold), list(spread_by))


@dataclass
class ConversionModel:
    """A fitted classifier with everything that is needed to score new rows.

    ``grown`` are all trees of the training, of which the first ``best_iteration`` score. ``encoded`` are the rows it was trained
    and checked on, as the trees see them (label, weight, split, features); a loaded model has none.
    """

    grown: oblivious.Trees
    numbers: list[str]
    statistics: list[CategoryStatistics] = field(default_factory=list)
    best_iteration: int = 0
    learning_losses: dict[str, list[float]] = field(default_factory=dict)
    encoded: DataFrame | None = None

    @property
    def trees(self) -> oblivious.Trees:
        return self.grown.first(self.best_iteration)

    @property
    def feature_names(self) -> list[str]:
        return [*[s.column for s in self.statistics], *self.numbers]

    def encode(self, df: DataFrame) -> DataFrame:
        """``df`` and a rate for each text column."""
        return with_rates(df, self.statistics)

    def score(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Add ``score``, the probability of the positive class, and ``prediction``."""
        kept = [c for c in df.columns if c not in ("score", "prediction")]
        scored = self.encode(df).select(*kept, self.trees.score_column().alias("score"))
        return scored.withColumn("prediction", F.when(F.col("score") > threshold, 1).otherwise(0))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.grown.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        self.grown.leaves(spark).write.mode("overwrite").parquet(f"{path}/leaves")
        for s in self.statistics:
            s.table.write.mode("overwrite").parquet(f"{path}/statistics/{s.column}")
        meta = {"features": self.grown.features, "numbers": self.numbers, "best_iteration": self.best_iteration,
                "learning_losses": self.learning_losses,
                "statistics": [[s.column, s.prior, s.prior_weight] for s in self.statistics]}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> ConversionModel:
        spark = SparkSession.active()
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        statistics = [CategoryStatistics(c, spark.read.parquet(f"{path}/statistics/{c}"), prior, weight)
                      for c, prior, weight in meta["statistics"]]
        grown = oblivious.Trees.from_tables(meta["features"], spark.read.parquet(f"{path}/nodes"),
                                            spark.read.parquet(f"{path}/leaves"))
        return cls(grown, meta["numbers"], statistics, meta["best_iteration"], meta["learning_losses"])


def best_with_patience(losses: Iterable[float], patience: int) -> tuple[int, bool]:
    """Number of iterations to keep, up to the lowest loss seen before ``patience`` rounds without a lower one;
    and whether that patience ran out."""
    best, best_at = float("inf"), 0
    for i, loss in enumerate(losses):
        if loss < best:
            best, best_at = loss, i
        elif i - best_at >= patience:
            return best_at + 1, True
    return best_at + 1, False


def best_iterations(curve: DataFrame, patience: int) -> DataFrame:
    """(split, iteration, logloss): the lowest loss of each split's ``curve`` before patience ran out.

    A curve has a row per iteration, of which there are as many as the training allows.
    """
    up = Window.partitionBy("split").orderBy("iteration")
    lowest = F.min(F.struct("logloss", "iteration")).over(up)
    stop = F.min(F.when(F.col("iteration") - F.col("low.iteration") >= patience, F.col("iteration"))).over(
        Window.partitionBy("split"))
    seen = curve.withColumn("low", lowest).withColumn("stop", stop)
    return seen.where(F.col("stop").isNull() | (F.col("iteration") <= F.col("stop"))).groupBy("split").agg(
        F.min(F.struct("logloss", "iteration")).alias("best")).select("split", "best.iteration", "best.logloss")


def _values(df: DataFrame, columns: list[str], *kept: Column) -> DataFrame:
    """A row per known value: what is ``kept`` of its row, ``__c`` (the column's number) and ``__v``."""
    pairs = [F.struct(F.lit(i).alias("__c"), F.col(f"`{c}`").alias("__v")) for i, c in enumerate(columns)]
    return df.select(*kept, F.explode(F.array(*pairs)).alias("__pair")).select(
        "*", "__pair.__c", "__pair.__v").drop("__pair").where("__v IS NOT NULL")


def ordered_rates(df: DataFrame, columns: list[str], label: str, row: str, prior: float, prior_weight: float = 1.0,
                  seed: int = 64, group: str | None = None, digits: int = 3) -> DataFrame:
    """``row`` and, per text column, ``<column>__rate``: the smoothed share of positives among *earlier* rows of the same value.

    Rows stand in the order of the MD5 of "seed:group" (``group`` is by default ``row``, which must be unique); rows of one group don't see each other. So no row
    is described by its own label, nor by one that it describes. NULLs get the prior.

    A value that any number of rows share is no one group: the order is cut into 16^``digits`` ranges by its first digits.
    Totals per value and range are summed along the ranges (a window over at most so many rows), and rows are
    numbered within their range only.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"`{group or row}`").cast("string")).cast("binary"))
    values = _values(df, columns, F.col(f"`{row}`").alias("__row"), F.col(f"`{label}`").cast("bigint").alias("__y"),
                     mark.alias("__mark")).withColumn("__range", F.substring("__mark", 1, digits))
    cell = ["__c", "__v", "__range"]
    totals = values.groupBy(*cell).agg(F.sum("__y").alias("__p"), F.count("*").alias("__n"))
    before = Window.partitionBy("__c", "__v").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    base = totals.select(*cell, F.coalesce(F.sum("__p").over(before), zero).alias("__p"),
                         F.coalesce(F.sum("__n").over(before), zero).alias("__n"))
    upto, peers = Window.partitionBy(*cell).orderBy("__mark"), Window.partitionBy(*cell, "__mark")
    inside = values.select("__row", *cell, (F.sum("__y").over(upto.rangeBetween(Window.unboundedPreceding, 0)) - F.sum("__y").over(peers)).alias("__q"),
                           (F.count("*").over(upto.rangeBetween(Window.unboundedPreceding, 0)) - F.count("*").over(peers)).alias("__m"))
    rate = (F.col("__p") + F.col("__q") + prior * prior_weight) / (F.col("__n") + F.col("__m") + prior_weight)
    return _side_by_side(df, columns, inside.join(base, cell).select("__row", "__c", rate.alias("__rate")), row, prior)


def _side_by_side(df: DataFrame, columns: list[str], rates: DataFrame, row: str, prior: float) -> DataFrame:
    """``row`` and a column of rates for each of ``columns``, from rows (__row, __c, __rate); the prior where there is none."""
    wide = rates.groupBy("__row").agg(F.lit(0).alias("__any"), *[
        F.max(F.when(F.col("__c") == i, F.col("__rate"))).alias(f"{c}__rate") for i, c in enumerate(columns)])
    out = df.select(F.col(f"`{row}`").alias("__row")).join(wide, "__row", "left")
    return out.select(F.col("__row").alias(row), *[F.coalesce(F.col(f"`{c}__rate`"), F.lit(prior)).alias(f"{c}__rate") for c in columns])


def known_rates(df: DataFrame, columns: list[str], counts: DataFrame, row: str, prior: float, prior_weight: float = 1.0) -> DataFrame:
    """As ``ordered_rates``, but by all rows counted in ``counts`` (__c, __v, positives, rows): what ``CategoryStatistics.encode`` gives,
    for all columns in one join. ``row`` must be unique and stored with the rows."""
    rate = (F.col("positives") + prior * prior_weight) / (F.col("rows") + prior_weight)
    rates = _values(df, columns, F.col(f"`{row}`").alias("__row")).join(counts, ["__c", "__v"]).select("__row", "__c", rate.alias("__rate"))
    return _side_by_side(df, columns, rates, row, prior)


def with_rates(df: DataFrame, statistics: list[CategoryStatistics]) -> DataFrame:
    """As ``CategoryStatistics.encode`` for one column after the other, for all columns in one join.

    Only values are joined, not the rows with all their columns. Rows are written once, with a number each, and may repeat.
    """
    if not statistics:
        return df
    rows = materialize(df.withColumn("__id", F.monotonically_increasing_id()), "rows_to_encode")
    counted = reduce(DataFrame.unionByName, [s.table.select(
        F.lit(i).alias("__c"), F.col(f"`{s.column}`").cast("string").alias("__v"), "positives", "rows") for i, s in enumerate(statistics)])
    sums = counted.groupBy("__c", "__v").agg(F.sum("positives").alias("p"), F.sum("rows").alias("n"))
    by_column = [F.when(F.col("__c") == i, s._smoothed(F.col("p"), F.col("n"))) for i, s in enumerate(statistics)]
    known = sums.select("__c", "__v", F.coalesce(*by_column).alias("__rate"))
    texts = rows.select("__id", *[F.col(f"`{s.column}`").cast("string").alias(s.column) for s in statistics])
    values = _values(texts, [s.column for s in statistics], F.col("__id").alias("__row"))
    found = values.join(known, ["__c", "__v"]).groupBy("__row").agg(
        *[F.max(F.when(F.col("__c") == i, F.col("__rate"))).alias(f"__r{i}") for i in range(len(statistics))])
    joined = rows.join(found.withColumnRenamed("__row", "__id"), "__id", "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns],
                         *[F.coalesce(f"__r{i}", F.lit(s.prior)).alias(s.output) for i, s in enumerate(statistics)])


def all_statistics(df: DataFrame, columns: list[str], label: str, params: TrainingParams,
                   prior: float) -> tuple[DataFrame | None, list[CategoryStatistics]]:
    """Positives and rows per value of every column, counted in one pass into one table; and its part for each column."""
    if not columns:
        return None, []
    values = _values(df, columns, F.col(f"`{label}`").cast("bigint").alias("__y"))
    table = materialize(values.groupBy("__c", "__v").agg(F.sum("__y").alias("positives"), F.count("*").alias("rows")), "statistics")
    return table, [CategoryStatistics(c, table.where(F.col("__c") == i).select(
        F.col("__v").alias(c), F.lit(0).alias("fold"), "positives", "rows"), prior, params.prior_weight) for i, c in enumerate(columns)]


def category_statistics(df: DataFrame, column: str, label: str, params: TrainingParams, prior: float) -> CategoryStatistics:
    """Positives and rows per value and fold; folds also spread a value that many rows share."""
    table = df.groupBy(column, "fold").agg(F.sum(F.col(label).cast("bigint")).alias("positives"),
                                           F.count("*").alias("rows"))
    return CategoryStatistics(column, materialize(table, f"statistics_{column}"), prior, params.prior_weight)


def row_weight(label: Column, positives: int, negatives: int, weighting: str) -> Column:
    """Weights that balance the classes: 'scale_pos_weight' (positives count negatives per positive),
    'class_weights' (each class its inverse frequency) or 'none'."""
    total = positives + negatives
    pair = {"scale_pos_weight": (negatives / positives, 1.0), "class_weights": (total / positives, total / negatives),
            "none": (1.0, 1.0)}[weighting]
    return F.when(label == 1, pair[0]).otherwise(pair[1])


def train(df: DataFrame, label: str = "label", key: str | None = None, split: str = "split", group: str | None = None,
          params: TrainingParams = TrainingParams()) -> ConversionModel:
    """Train on the rows marked 'train', keep the best iteration on 'validation'.

    Text columns are categories: in training, the share of positives among earlier rows in a random order describes
    them (``ordered_rates``), rows of one ``group`` (by default ``key``) not seeing each other; afterwards, the share among all training rows.
    Trees are grown until the validation loss has not fallen for ``patience`` of them; none is grown twice.
    """
    reserved = {label, split, *[c for c in (key, group) if c]}
    text, numbers = feature_types(df, exclude=reserved)
    rows = materialize(df.withColumn("__id", F.monotonically_increasing_id()), "training_rows")
    training, validation = rows.where(F.col(split) == "train"), rows.where(F.col(split) == "validation")
    facts = training.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")).first()
    positives, negatives = facts["pos"] or 0, facts["n"] - (facts["pos"] or 0)
    if not positives or not negatives:
        raise ValueError("training needs rows of both classes")
    prior = positives / facts["n"]
    counts, statistics = all_statistics(training, text, label, params, prior)
    if text:
        validation = validation.join(known_rates(validation, text, counts, "__id", prior, params.prior_weight), "__id")
        training = training.join(ordered_rates(training, text, label, "__id", prior, params.prior_weight, params.seed,
                                               group or key), "__id")
    names = [*[s.output for s in statistics], *numbers]
    weight = row_weight(F.col(label), positives, negatives, params.weighting).alias("weight")
    seen = [F.col(label).cast("int").alias("label"), weight, F.col(split).alias("split"),
            *[F.col(f"`{c}`").cast("double").alias(c) for c in names]]
    encoded = materialize(training.select(*seen).unionByName(validation.select(*seen)), "encoded")
    grown, best, losses = oblivious.fit(encoded, names, params.iterations, learning_rate=params.learning_rate, depth=params.depth,
                                        patience=params.patience, max_bins=params.max_bins, l2=params.l2)
    return ConversionModel(grown, numbers, statistics, best, losses, encoded)


_CURVE = "iteration int, split string, loss bigint, weight bigint"


def _curve_parts(trees: oblivious.Trees):
    def run(batches):
        sums: dict[tuple[int, str], list[int]] = {}
        for batch in batches:
            splits = np.array(batch.column("split").to_pylist(), object)
            label, weight = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "weight"))
            marks = [(s, splits == s) for s in set(splits)]
            margin = np.zeros(batch.num_rows)
            for t, leaf in enumerate(trees.leaf_numbers([batch.column(c) for c in trees.features])):
                margin = margin + trees.trees[t].values[leaf]
                losses = oblivious.fixed(weight * oblivious.row_losses(margin, label))
                for s, mine in marks:
                    total = sums.setdefault((t, s), [0, 0])
                    total[0] += int(losses[mine].sum())
                    total[1] += int(oblivious.fixed(weight[mine]).sum())
        if sums:
            yield pa.RecordBatch.from_pydict({
                "iteration": pa.array([t for t, _ in sums], pa.int32()), "split": [s for _, s in sums],
                "loss": pa.array([v[0] for v in sums.values()], pa.int64()), "weight": pa.array([v[1] for v in sums.values()], pa.int64())})
    return run


def learning_curve(trees: oblivious.Trees, encoded: DataFrame) -> DataFrame:
    """Weighted logistic loss after each tree, by split, from the rows themselves.

    ``encoded``: label, weight, split and the trees' features. Each task follows its rows' margins along the trees and
    sends one sum per tree and split.
    """
    columns = encoded.select("label", "weight", "split", *[F.col(f"`{c}`").cast("double").alias(c) for c in trees.features])
    sums = columns.where("split IS NOT NULL").mapInArrow(_curve_parts(trees), _CURVE).groupBy("iteration", "split").agg(
        F.sum("loss").alias("loss"), F.sum("weight").alias("weight"))
    return sums.select("iteration", "split", (F.col("loss") / F.col("weight")).alias("logloss"))


def prediction_change(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(feature, change): how much predictions change with a feature, over the tables of a model.

    At each level of a tree, two leaves that differ only in the level's split lie w0 w1 / (w0 + w1) (v0 - v1)^2 of weighted
    squares from their mean; a feature's change is the sum over its splits.
    """
    side = F.expr("leaf & shiftleft(1, level)")
    sides = leaves.join(nodes.select("tree", "level", "feature"), "tree").select(
        "tree", "level", "feature", F.col("leaf").bitwiseXOR(side).alias("pair"), (side > 0).alias("above"), "value", "weight")
    pick = lambda above, c: F.max(F.when(F.col("above") == above, F.col(c)))
    pairs = sides.groupBy("tree", "level", "feature", "pair").agg(
        pick(False, "value").alias("v0"), pick(True, "value").alias("v1"), pick(False, "weight").alias("w0"), pick(True, "weight").alias("w1"))
    both = F.col("w0") + F.col("w1")
    gap = F.col("v0") - F.col("v1")
    return pairs.groupBy("feature").agg(F.sum(F.when(both > 0, F.col("w0") * F.col("w1") / both * gap * gap).otherwise(0.0)).alias("change"))


def _leaf_parts(trees: oblivious.Trees):
    def run(batches):
        sums: list[np.ndarray] = []
        for batch in batches:
            weight = oblivious.fixed(batch.column("weight").to_numpy(zero_copy_only=False).astype(float))
            found = [np.bincount(leaf, weight, len(tree.values)).astype(np.int64) for tree, leaf in zip(
                trees.trees, trees.leaf_numbers([batch.column(c) for c in trees.features]))]
            sums = [a + b for a, b in zip(sums, found)] if sums else found
        if sums:
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array(np.repeat(np.arange(len(sums), dtype=np.int32), [len(s) for s in sums])),
                "leaf": pa.array(np.concatenate([np.arange(len(s), dtype=np.int32) for s in sums])),
                "weight": pa.array(np.concatenate(sums))})
    return run


def leaf_weights(trees: oblivious.Trees, encoded: DataFrame) -> DataFrame:
    """(tree, leaf, value, weight): the weight of the rows of ``encoded`` (weight, the trees' features) in every leaf.

    A task sends one number per leaf.
    """
    columns = encoded.select("weight", *[F.col(f"`{c}`").cast("double").alias(c) for c in trees.features])
    sums = columns.mapInArrow(_leaf_parts(trees), "tree int, leaf int, weight bigint").groupBy("tree", "leaf").agg(
        (F.sum("weight") / oblivious.UNIT).alias("weight"))
    values = trees.leaves(SparkSession.active()).select("tree", "leaf", "value")
    return values.join(sums, ["tree", "leaf"], "left").select("tree", "leaf", "value", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def importance(trees: oblivious.Trees, names: list[str] | None = None, encoded: DataFrame | None = None) -> DataFrame:
    """Importance per feature: the change of predictions, scaled to a sum of 100 (0 where no tree splits); most important first.

    Leaves weigh as the rows of ``encoded`` that reach them, or, without it, as in training.
    """
    spark = SparkSession.active()
    features = spark.createDataFrame(list(zip(trees.features, names or trees.features)), "feature string, name string")
    leaves = trees.leaves(spark) if encoded is None else leaf_weights(trees, encoded)
    changes = prediction_change(trees.nodes(spark), leaves).join(features, "feature", "right").select(
        F.col("name").alias("feature"), F.coalesce("change", F.lit(0.0)).alias("change"))
    total = F.sum("change").over(Window.partitionBy())  # a row per feature
    share = F.when(total > 0, F.col("change") * 100.0 / total).otherwise(0.0)
    return changes.select("feature", share.alias("importance")).orderBy(F.desc("importance"), "feature")


def feature_importance(model: ConversionModel) -> DataFrame:
    """Importance of the model's columns over its training rows (a loaded model: by the weights it was stored with)."""
    rows = None if model.encoded is None else model.encoded.where("split = 'train'")
    return importance(model.trees, model.feature_names, rows)
