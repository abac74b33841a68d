"""Centroid clustering of vectors by Lloyd's rounds, with distances skipped by ns-bounds.

Each vector keeps an upper bound of the distance to its centroid and a lower bound for each other one,
with the round in which each was measured. Later a bound is loosened by how far its centroid has moved
*in all* since that round (the norm of the whole displacement, from the kept history of centroids), which is
at most the sum of its moves. Where the bounds can't tell that the nearest centroid is the same, the vector is
measured against all centroids again, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conversion_engine.llm import common

#: Components are held between these, so that squared distances fit a long.
LIMIT = 1 << 24
#: Bounds are doubles: a skipped distance must be larger by more than their rounding.
_SLACK = 1e-9
_STATE = "_v array<int>, _a int, _u double, _ut int, _l array<double>, _lt array<int>"


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows ``v`` to integer rows ``c``."""
    top = int(max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * top * top * v.shape[1] < 1 << 53:  # every sum below is an integer that a double holds
        a, b = v.astype(float), c.astype(float)
        out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        return out.astype(np.int64)
    out = np.empty((len(v), len(c)), np.int64)
    for j, row in enumerate(c.astype(np.int64)):
        step = v - row
        out[:, j] = (step * step).sum(1)
    return out


def displacements(history: np.ndarray) -> np.ndarray:
    """[s, j]: how far centroid j is now from where it was in round s."""
    return np.sqrt(((history[-1][None] - history).astype(float) ** 2).sum(2))


def reassign(v: np.ndarray, a: np.ndarray, u: np.ndarray, ut: np.ndarray, l: np.ndarray, lt: np.ndarray,
             history: np.ndarray) -> int:
    """Assign each row to its nearest centroid of the last round, in place; the number of rows measured anew.

    Rows with ``a`` < 0 have not been measured yet.
    """
    now, moved, k = len(history) - 1, displacements(history), history.shape[1]
    upper = u + moved[ut, np.maximum(a, 0)]
    lower = l - moved[lt, np.arange(k)[None, :]]
    lower[np.arange(len(a)), np.maximum(a, 0)] = np.inf
    failed = np.flatnonzero((a < 0) | ~(upper * (1 + _SLACK) + _SLACK < lower.min(1) * (1 - _SLACK)))
    if len(failed):
        exact = squared(v[failed], history[-1])
        a[failed] = exact.argmin(1)  # the first of equal ones
        roots = np.sqrt(exact.astype(float))
        u[failed], ut[failed] = roots[np.arange(len(failed)), a[failed]], now
        l[failed], lt[failed] = roots, now
    return len(failed)


def _reassigner(history: np.ndarray, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, width = history.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 16 << 20, 1 << 14):
            v = _matrix(batch.column("_v"), width, np.int64)
            a, u, ut = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("_a", "_u", "_ut"))
            l, lt = _matrix(batch.column("_l"), k, float), _matrix(batch.column("_lt"), k, np.int32)
            reassign(v, a, u, ut, l, lt, history)
            offsets = pa.array(np.arange(len(a) + 1) * k, pa.int32())
            made = {"_a": pa.array(a), "_u": pa.array(u), "_ut": pa.array(ut),
                    "_l": pa.ListArray.from_arrays(offsets, pa.array(l.ravel())),
                    "_lt": pa.ListArray.from_arrays(offsets, pa.array(lt.ravel()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in names], names)
    return run


def _summer(k: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: cluster, rows, and the sum of each component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in common.slices(batches, 16 << 20, 1 << 14):
            a, v = batch.column("_a").to_numpy(), _matrix(batch.column("_v"), width, np.int64)
            rows += np.bincount(a, minlength=k)
            for j in np.unique(a):
                sums[j] += v[a == j].sum(0)
        yield pa.RecordBatch.from_pydict({"_a": pa.array(np.arange(k, dtype=np.int32)), "_n": rows, "_s": sums.tolist()},
                                         pa.schema([("_a", pa.int32()), ("_n", pa.int64()), ("_s", pa.list_(pa.int64()))]))
    return run


def moved_centroids(state: DataFrame, last: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays.

    Tasks send one row per cluster; the driver gets clusters times components, the size of the model.
    """
    k, width = last.shape
    parts = state.select("_a", "_v").mapInArrow(_summer(k, width), "_a int, _n long, _s array<long>")
    wide = parts.select("_a", "_n", F.posexplode("_s").alias("_i", "_s")).groupBy("_a", "_i").agg(
        F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    out = last.copy()
    for row in wide.where("_n > 0").collect():
        out[row["_a"], row["_i"]] = row["_s"] // row["_n"]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of "seed:id", in that order (equal ids: by their components)."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    rows = vectors.select(mark.alias("_mark"), "_v").orderBy(F.asc_nulls_last("_mark"), "_v").limit(k).collect()
    return np.array([r["_v"] for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1,
                    id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Every usable vector with its cluster: ``id_column``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become integers, floor(``scale`` * x), so that distances, means and ties are exact. The first
    centroids are chosen by hash; each of ``rounds`` rounds assigns all vectors (ties: the smaller number) and moves
    the centroids to the floors of their vectors' means; the vectors are then assigned once more. The result is that of
    Lloyd's rounds without bounds. The vectors' bounds are a table per round; centroids and their history
    (``rounds`` + 1 times ``k`` times ``width`` numbers) go to every task.

    Left out: NULL vectors, those of another width than ``width``, and those with NULL or non-finite components.
    Scaled components beyond 2^24 count as 2^24. Repeated rows are vectors of their own; a NULL id is chosen last.
    Fewer than ``k`` usable vectors make fewer clusters, none an empty result. Sums beyond a long are NULL.
    Other columns are not returned.
    """
    spark, shelf = vectors.sparkSession, common.Shelf(vectors.sparkSession, "centroids")
    x, kind = F.col(f"`{vector_column}`"), vectors.schema[id_column].dataType
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)),
                                                        c.cast("double") * scale))).cast("int"))
    usable = vectors.where((F.size(x) == width) & finite).select(F.col(f"`{id_column}`").alias("_id"), whole.alias("_v"))
    first = first_centroids(usable, k, seed)
    if not len(first):
        facts = T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        return spark.createDataFrame([], T.StructType([T.StructField(id_column, kind), *facts.fields]))
    k = len(first)
    zeros = F.array_repeat(F.lit(0.0), k)
    state = usable.select("_id", "_v", F.lit(-1).alias("_a"), F.lit(0.0).alias("_u"), F.lit(0).alias("_ut"),
                          zeros.alias("_l"), F.array_repeat(F.lit(0), k).alias("_lt"))
    history, names, last = first[None], state.columns, None
    schema = T.StructType([T.StructField("_id", kind), *T.StructType.fromDDL(_STATE).fields])
    for turn in range(rounds + 1):
        state = shelf.put(state.mapInArrow(_reassigner(history, names), schema), f"round-{turn}")
        if last:
            shelf.drop(last)
        last = f"round-{turn}"
        if turn < rounds:
            history = np.concatenate([history, moved_centroids(state, history[-1])[None]])

    final = history[-1]
    centre = F.element_at(F.lit(final.astype(int).tolist()).cast("array<array<long>>"), F.col("_a") + 1)
    gaps = F.zip_with(F.col("_v").cast("array<long>"), centre, lambda p, q: (p - q) * (p - q))
    rows = state.select("_id", F.col("_a").alias("cluster"), F.aggregate(gaps, F.lit(0).cast("long"), lambda s, d: s + d).alias("distance"))
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(int(r["s"]) for r in per))
    facts = [(r["cluster"], fits(int(r["s"])), total,
              hashlib.sha256(",".join(map(str, final[r["cluster"]])).encode()).hexdigest()) for r in per]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(  # ``k`` rows
        F.col("_id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
