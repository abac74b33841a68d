"""Attribution of single predictions to features, by exact Shapley values."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conversion_engine.ml.oblivious import Tree, Trees, quoted
from conversion_engine.ml.training import ConversionModel


def _expected(tree: Tree, known: set[int]) -> np.ndarray:
    """The tree's value for each leaf number of a row of which only the ``known`` features are used.

    At a split by another feature both sides count by the training weight in them (evenly, if there is none).
    """
    depth = len(tree.splits)
    sides = (2,) * depth
    # Axis i of these is level depth - 1 - i; a node of a level is fixed by the splits of the levels before it.
    values, weights = tree.values.reshape(sides), tree.weights.reshape(sides)
    out = np.broadcast_to(values[None], (1 << depth, *sides))
    rows = np.arange(1 << depth)
    for level in reversed(range(depth)):  # the deepest level is the first axis
        low, high = weights[0], weights[1]
        if tree.splits[level][0] in known:
            out = out[rows, (rows >> level) & 1]
        else:
            total = low + high
            share = np.divide(low, total, out=np.full(np.shape(total), 0.5), where=total > 0)
            out = share * out[:, 0] + (1 - share) * out[:, 1]
        weights = low + high
    return out


def tree_attributions(tree: Tree) -> tuple[list[int], np.ndarray, float]:
    """A tree's features, the Shapley values [leaf, feature] of the rows of each leaf, and the value without any feature.

    All that a row's attribution depends on in an oblivious tree is the leaf it reaches, so that one table describes all rows.
    """
    features = sorted({s[0] for s in tree.splits})
    worth = {frozenset(c): _expected(tree, set(c)) for n in range(len(features) + 1) for c in combinations(features, n)}
    count = len(features)
    out = np.zeros((len(tree.values), count))
    for i, f in enumerate(features):
        for others, value in worth.items():
            if f not in others:
                n = len(others)
                out[:, i] += factorial(n) * factorial(count - n - 1) / factorial(count) * (worth[others | {f}] - value)
    return features, out, float(worth[frozenset()][0])


def attributions(trees: Trees, encoded: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns, base, and ``values``: a Shapley value for each of the trees' features, which add up to margin minus base."""
    tables = [tree_attributions(t) for t in trees.trees]
    base = float(sum(b for _, _, b in tables))

    @F.arrow_udf("array<double>")
    def values(*columns: pa.Array) -> pa.Array:
        total = np.zeros((len(columns[0]), len(trees.features)))
        for (features, table, _), leaf in zip(tables, trees.leaf_numbers(columns)):
            total[:, features] += table[leaf]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))
    columns = [F.col(quoted(c)).cast("double") for c in trees.features]
    return encoded.select(*kept, F.lit(base).alias("base"), values(*columns).alias("values"))


def named(found: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``key``, base, ``feature``, ``value``: a row per feature."""
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__i") + 1)
    return found.select(key, "base", F.posexplode("values").alias("__i", "value")).select(key, "base", named.alias("feature"), "value")


def shapley_values(model: ConversionModel, rows: DataFrame, key: str) -> DataFrame:
    """Shapley values of every row on the scale of the margin: ``key``, base, ``feature``, ``value``.

    They are exact for the path-dependent game (features that are not used count by the training weights along the path):
    a row's values add up to its margin minus base, for every row, without reference rows or sampled orders.
    """
    encoded = model.encode(rows)
    return named(attributions(model.trees, encoded, key), key, model.feature_names)


def shapley_summary(values: DataFrame) -> DataFrame:
    """Mean size and mean direction of the attributions per feature."""
    return values.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs_value"), F.avg("value").alias("mean_value"))
