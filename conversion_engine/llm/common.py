"""What several operators share: stored intermediates, row keys, words, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conversion_engine.session import run_folder

#: Words are separated by these characters alone (ASCII white space).
SPACES = r"[\x20\x09-\x0D]+"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the input does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ..., which clash with no name that starts with an underscore; and the new names by the old."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def row_key(*columns: str) -> list[Column]:
    """Two hashes that identify a row by the values of ``columns``, NULLs included.

    Rows equal in all these columns are one row to an operator that uses them.
    """
    names = [F.col(f"`{c}`") for c in columns]
    return [F.xxhash64(*names), F.xxhash64(F.lit(0x5EED), *reversed(names))]


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished write are of no use any more; Spark drops them at its end."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


class Shelf:
    """Tables of one run of one operator, in a folder of its own in the application's under ``spark.checkpoint.dir``.

    A written table cuts the lineage and survives lost executors. Tables go with
    :meth:`drop`; what a lazy result still reads goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.names = spark, []
        self.path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        with _shuffles_freed(self.spark):
            df.write.parquet(f"{self.path}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        fs, where = self._fs(f"{self.path}/{name}")
        fs.delete(where, True)
        self.names.remove(name)

    def keep(self, *names: str) -> None:
        """Drop all tables but these, which the result still reads."""
        for name in [n for n in self.names if n not in names]:
            self.drop(name)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 2 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(batch.num_rows * max_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (u, v).

    Alternating star contraction: neighbours are tied to the smallest neighbour,
    first those above a node, then those below it. The number of rounds grows
    with the logarithm of the longest path. Minima are partial aggregates and
    the joins are plain, so a node with very many neighbours is no hot group.
    Nodes without edges do not appear.
    """
    down = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    run = uuid.uuid4().hex
    name = f"star-{run}-0"
    now = shelf.put(edges.where("u != v").select(*down).distinct(), name)
    seen, turn = None, 0
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen, turn = state, turn + 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, name = name, f"star-{run}-{turn}"
        now = shelf.put(small.union(below.select("u", F.col("m").alias("v"))).distinct(), name)
        shelf.drop(last)
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
#: A random number for each byte, nothing for white space; the same with A-Z as a-z.
_BYTE = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256).astype(np.uint64)
_BYTE[_SPACE] = 0
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_PLACE_BASE = 0xC2B2AE3D27D4EB4F


@lru_cache(maxsize=4)
def _places(n: int) -> np.ndarray:
    """Powers of a base, one for each place of a byte in its word."""
    out = np.full(n, _PLACE_BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed_words(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one more than texts).

    Words are separated by ASCII white space; with ``fold`` A-Z count as a-z. The bytes of all texts are worked on
    together: a word's hash is the mixed sum of its bytes' numbers, each times its place's power.
    """
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = _SPACE[buffer]
    first = ~space
    first[1:] &= space[:-1]
    start = np.flatnonzero(first)
    bounds = np.searchsorted(start, edges)
    if not len(start):
        return np.zeros(0, np.uint64), bounds
    place = np.arange(start[0], len(buffer))
    place -= np.repeat(start, np.diff(np.append(start, len(buffer))))
    place[space[start[0]:]] = 0
    most = 1 << int(place.max() + 1).bit_length()
    terms = (_BYTE_FOLDED if fold else _BYTE)[buffer[start[0]:]]
    terms *= _places(most)[place]
    return mixed(np.add.reduceat(terms, start - start[0])), bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of ``length`` words: polynomials of the odd ``base``, by doubling."""
    total, size, step = None, 0, hashes
    left, span = length, 1
    while left:  # binary digits of the length; step holds the hashes of runs of span words
        if left & 1:
            if total is None:
                total, size = step, span
            else:
                n = len(hashes) - size - span + 1
                total = total[:n] * _power(base, span) + step[size:size + n]
                size += span
        left >>= 1
        if left:
            n = len(hashes) - 2 * span + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            step = step[:n] * _power(base, span) + step[span:span + n]
            span *= 2
    return mixed(total)


def _power(base: int, exponent: int) -> np.uint64:
    return np.uint64(pow(base, exponent, 1 << 64))
