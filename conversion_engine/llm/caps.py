"""Near-equal vectors by spherical-cap filters: random product codes, list decoding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conversion_engine.llm import common

PARTS = 4


@lru_cache(maxsize=32)
def code(seed: int, dim: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation and, for each of four parts of the rotated vector, ``words`` random unit vectors.

    A filter direction is one word of every part: ``words ** 4`` of them, never listed.
    """
    random = np.random.default_rng([seed, dim, words])
    padded = -(-dim // PARTS) * PARTS
    rotation, _ = np.linalg.qr(random.normal(size=(padded, padded)))
    vectors = random.normal(size=(PARTS, words, padded // PARTS))
    return rotation[:, :dim], vectors / np.linalg.norm(vectors, axis=2, keepdims=True)


def decode(unit: np.ndarray, seed: int, words: int, filters: int) -> np.ndarray:
    """For each unit vector the ``filters`` directions nearest to it, without looking at all of them.

    They are the directions that exceed the height of a cap around the vector; the height is the vector's
    own, so that vectors far from all words have no fewer. Halves of the code are ranked first: a sum among the best
    ``filters`` joins the i-th best of one half to the j-th of the other with i * j <= filters.
    """
    rotation, vectors = code(seed, unit.shape[1], words)
    turned = unit @ rotation.T
    size = vectors.shape[2]
    products = [turned[:, p * size:(p + 1) * size] @ vectors[p].T for p in range(PARTS)]
    halves = []
    for first, second in (products[:2], products[2:]):
        sums = (first[:, :, None] + second[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(-sums, axis=1, kind="stable")[:, :filters]
        halves.append((np.take_along_axis(sums, best, 1), best))
    (high, left), (low, right) = halves
    i, j = np.array([(a, b) for a in range(left.shape[1]) for b in range(right.shape[1])
                     if (a + 1) * (b + 1) <= filters]).T
    best = np.argsort(-(high[:, i] + low[:, j]), axis=1, kind="stable")[:, :filters]
    return np.take_along_axis(left[:, i] * (words * words) + right[:, j], best, 1)


def unit_rows(values: list) -> np.ndarray:
    """Rows of length one, in double precision."""
    rows = np.array(values, np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector: str) -> Column:
    """Vectors with a direction: components all there and finite, not all zero."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _filters(seeds: int, words: int, filters: int):
    """(class, label, vector, dim, filters): filters sorted, distinct for each of the ``seeds`` codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, rows=512):
            vectors = part.column(2).to_pylist()
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                unit = unit_rows([vectors[i] for i in mine])
                found = np.sort(np.concatenate(
                    [decode(unit, seed, words, filters) + seed * words ** PARTS for seed in range(seeds)], axis=1), axis=1)
                rows = part.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), rows.column(3),
                    pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(np.full(len(mine), dim, np.int32)),
                    pa.array(found.tolist(), pa.list_(pa.int64()))],
                    names=["_c", "_label", "_count", "_v", "_dim", "_filters"])
    return run


def verify(filter_id: int, mine: np.ndarray, unit: np.ndarray, lists: np.ndarray, least: float,
           low: int, high: int) -> np.ndarray:
    """Links among the vectors of one filter that no smaller common filter shows too.

    ``mine`` are the vectors' blocks; of two blocks only pairs across them count.
    """
    links = unit @ unit.T >= least
    np.fill_diagonal(links, False)
    if low != high:
        links &= mine[:, None] != mine[None, :]
    if links.any():
        smaller = np.unique(lists[lists < filter_id])
        if len(smaller):
            has = np.zeros((len(unit), len(smaller)), np.float32)
            row, at = np.nonzero(lists < filter_id)
            has[row, np.searchsorted(smaller, lists[row, at])] = 1
            links &= has @ has.T == 0
    return links


def _roots(links: np.ndarray) -> np.ndarray:
    """For every vector the first one reachable by links."""
    root = np.arange(len(links))
    while True:
        best = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1))
        best = best[best]
        if (best == root).all():
            return root
        root = best


def _verified(least: float):
    """From sorted (label, dim, filter, low, high, block, class, count, vector, filters) rows: (class, root, links)."""
    def group(rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        _, _, filter_id, low, high, block, c, count, v, lists = zip(*rows)
        links = verify(filter_id[0], np.array(block), np.stack([np.frombuffer(x) for x in v]), np.array(lists), least,
                       low[0], high[0])
        some = np.flatnonzero(links.any(axis=1))
        if not len(some):
            return None
        c, weight = np.array(c), links @ np.array(count)
        return pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(c[_roots(links)[some]]), pa.array(weight[some])],
                                          names=["_c", "_root", "_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][:5] != row[:5]:
                    if (out := group(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if (out := group(held)) is not None:
            yield out
    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding",
                 label_column: str = "label", seeds: int = 4, words: int = 16, filters: int = 8,
                 block: int = 256) -> DataFrame:
    """(``id_column``, n_links, component_id, kept): vectors with equal labels and a cosine of ``least`` or more are linked.

    Every distinct vector goes into ``filters`` buckets for each of ``seeds`` product codes of
    ``words ** 4`` directions; vectors that meet in a bucket are compared in double precision. A pair
    that meets in several buckets counts in the first. Buckets of more than ``block`` vectors are
    dealt out as pairs of blocks, and a bucket yields a count and one link a vector, never its pairs. Cosines of links
    are exact; links are found with a probability (README). More data asks for more ``words``: a bucket holds about
    filters / words ** 4 of a label's vectors.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows with a NULL label, link with
    nothing; different lengths don't link. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable (not NULL if there is one), ``kept`` is true where it is the row's own id or
    there is none. Repeated rows link with each other. Other columns are ignored. An empty table gives no row.
    """
    shelf = common.Shelf(vectors.sparkSession, "caps")
    source = vectors.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{label_column}`").cast("string").alias("_label"),
                            F.col(f"`{vector_column}`").alias("_vector"))
    keyed = source.withColumn("_c", F.when(usable("_vector") & F.col("_label").isNotNull(),
                                           F.xxhash64("_label", "_vector")))
    classes = keyed.where("_c IS NOT NULL").groupBy("_c").agg(
        F.first("_label").alias("_label"), F.first("_vector").alias("_vector"), F.count("*").alias("_count"))
    filtered = shelf.put(classes.mapInArrow(
        _filters(seeds, words, filters),
        "_c long, _label string, _count long, _v binary, _dim int, _filters array<long>"), "filtered")
    key = ["_label", "_dim", "_filter"]
    entries = filtered.select("_c", "_label", "_dim", F.explode("_filters").alias("_filter"))
    sizes = entries.groupBy(*key).agg(F.count("*").alias("_size")).where("_size > 1") \
        .select(*key, F.ceil(F.col("_size") / block).cast("int").alias("_blocks"))
    dealt = entries.join(sizes, key).withColumn("_block", F.pmod(F.hash("_c"), F.col("_blocks"))).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    parts = [*key, "_low", "_high"]
    rows = dealt.select("_c", "_label", "_dim", "_filter", "_block", F.least("_block", "_other").alias("_low"),
                        F.greatest("_block", "_other").alias("_high")) \
        .join(filtered.select("_c", "_count", "_v", "_filters"), "_c") \
        .select(*parts, "_block", "_c", "_count", "_v", "_filters")
    found = shelf.put(rows.repartition(*parts).sortWithinPartitions(*parts).mapInArrow(
        _verified(least), "_c long, _root long, _links long"), "found")
    groups = common.components(found.select(F.col("_c").alias("u"), F.col("_root").alias("v")), shelf)
    linked = found.groupBy("_c").agg(F.sum("_links").alias("_links"))
    members = classes.select("_c", "_count").join(linked, "_c", "left") \
        .join(groups.select(F.col("node").alias("_c"), "component"), "_c", "left") \
        .select("_c", (F.coalesce("_links", F.lit(0)) + F.col("_count") - 1).alias("_n"),
                F.coalesce("component", "_c").alias("_group"))
    named = shelf.put(keyed.select("_id", "_c").join(members, "_c", "left"), "named")
    shelf.keep("named")
    least_id = named.where("_group IS NOT NULL").groupBy("_group").agg(F.min("_id").alias("_least"))
    component = F.when(F.col("_group").isNull(), F.col("_id")).otherwise(F.col("_least"))
    return named.join(least_id, "_group", "left").select(
        F.col("_id").alias(id_column), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("_id"), component.isNull()).alias("kept"))
