"""Fingerprints by order MinHash: how alike two texts are, with the order of their parts.

A text's k-mers (of code points) are numbered by occurrence, so that repeats count. Each of many random orders
selects its smallest numbered k-mers; they are put back into text order and hashed as a tuple. Two texts
agree on a tuple if the same k-mers are selected and stand in the same order, which edits, and moved passages, undo.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conversion_engine.llm import common

K, CHOSEN, ORDERS = 12, 2, 64
_ROUND = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint64(0x2545F4914F6CDD1D)
#: Order i compares hashes by their exclusive or with number i.
_ORDERS = np.random.default_rng(0x0123).integers(0, 1 << 63, ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def numbered_kmers(points: np.ndarray, k: int = K) -> tuple[np.ndarray, int]:
    """Sorted hashes of the k-mers with their occurrence numbers; the low bits (as many as returned) hold the places.

    A text shorter than ``k`` is one k-mer.
    """
    hashes = common.mixed(points.astype(np.uint64) * _ROUND + np.uint64(1))
    hashes = common.window_hashes(hashes, min(k, len(points)))
    bits = max(1, int(len(hashes) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    place = np.arange(len(hashes), dtype=np.uint64)
    found = np.sort((hashes & ~low) | place)
    kmer = found >> np.uint64(bits)
    again = np.concatenate([[False], kmer[1:] == kmer[:-1]])
    if again.any():  # the first occurrence keeps its hash, the others get one of their own
        at = np.arange(len(found))
        number = at - np.maximum.accumulate(np.where(again, 0, at))
        rows = np.flatnonzero(again)
        fresh = common.mixed((found[rows] & ~low) + number[rows].astype(np.uint64) * _ROUND)
        found[rows] = (fresh & ~low) | (found[rows] & low)
        found.sort()
    return found, bits


def fingerprint(points: np.ndarray, k: int = K, chosen: int = CHOSEN) -> np.ndarray:
    """One 16-bit number for each order; nothing for an empty text."""
    if not len(points):
        return np.zeros(0, np.uint16)
    found, bits = numbered_kmers(points, k)
    want, shift = min(chosen, len(found)), np.uint64(bits)
    low = np.uint64((1 << bits) - 1)
    start, end = np.zeros(ORDERS, np.int64), np.full(ORDERS, len(found))
    # In an order, hashes that share more leading bits with its number come first. So the smallest stand
    # together in the sorted hashes: a stretch that shares a prefix and holds enough of them has them all.
    rest, prefix = np.arange(ORDERS), max(0, len(found).bit_length() - 5)
    while len(rest) and prefix > 0:
        tail = np.uint64((1 << (64 - prefix)) - 1)
        lo = np.searchsorted(found, _ORDERS[rest] & ~tail)
        hi = np.searchsorted(found, _ORDERS[rest] | tail, "right")
        enough = hi - lo >= want
        start[rest[enough]], end[rest[enough]] = lo[enough], hi[enough]
        rest, prefix = rest[~enough], prefix - 2
    at = start[:, None] + np.arange((end - start).max())[None, :]
    inside = at < end[:, None]
    values = found[np.minimum(at, len(found) - 1)]
    rank = np.where(inside, (values & ~low) ^ (_ORDERS[:, None] & ~low), _FULL)
    rows = np.arange(ORDERS)
    picked = []
    for _ in range(want):
        best = rank.argmin(1)
        picked.append(values[rows, best])
        rank[rows, best] = _FULL
    picked = np.stack(picked, 1)
    picked = np.take_along_axis(picked, (picked & low).argsort(1, kind="stable"), 1)  # in the order of the text
    tuples = np.full(ORDERS, _PAD)
    for c in range(want):
        tuples = common.mixed(tuples * _ROUND + (picked[:, c] >> np.maximum(shift, np.uint64(32))))
    return (tuples >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal tuples; two empty texts are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def written(numbers: np.ndarray) -> str:
    return numbers.astype(">u2").tobytes().hex()


class _Doc(NamedTuple):
    key: object
    text: str
    points: np.ndarray
    numbers: np.ndarray


def _doc(key: object, text: str | None) -> _Doc:
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    return _Doc(key, text or "", points, fingerprint(points))


def _compared(doc: _Doc, after: _Doc) -> dict[str, object]:
    """The fingerprints of a document and of its text with the last quarter taken from the next one."""
    quarter = len(doc.points) // 4
    kept = len(doc.points) - quarter
    edited = fingerprint(np.concatenate([doc.points[:kept], after.points[:quarter]]))
    return {"n_chars": len(doc.points),
            "edited_sha256": hashlib.sha256((doc.text[:kept] + after.text[:quarter]).encode()).hexdigest(),
            "fingerprint": written(doc.numbers), "edited_fingerprint": written(edited),
            "near_edited": likeness(doc.numbers, edited), "near_next": likeness(doc.numbers, after.numbers)}


_MADE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ENDS = "_part int, _first string, _last string"
_EMPTY = dict.fromkeys(("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                        "_part", "_first", "_last"))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _streamed(schema: T.StructType):
    """Documents of a sorted range, each compared with the following one. The first and the last row carry their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = _arrow(schema), TaskContext.get().partitionId()
        held, first = None, True
        for batch in common.slices(batches):
            out = []
            for key, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                doc = _doc(key, text)
                if held is not None:
                    out.append({**_EMPTY, "_id": held.key, **_compared(held, doc), "_part": part,
                                "_first": held.text if first else None})
                    first = False
                held = doc
            if out:
                yield pa.RecordBatch.from_pylist(out, made)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{**_EMPTY, "_id": held.key, "_part": part, "_last": held.text,
                                               "_first": held.text if first else None}], made)
    return run


def _joined(schema: T.StructType):
    """Last documents of the ranges, with the text that follows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _arrow(schema)
        for batch in common.slices(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("_id", "_last", "_after")))
            yield pa.RecordBatch.from_pylist([{"_id": i, **_compared(_doc(i, a), _doc(None, b))} for i, a, b in rows], made)
    return run


def fingerprints(docs: DataFrame, passes: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text is the document's with its last quarter (rounded down) replaced by as many first code points of the
    next document in ascending id, or all it has; the last document's next is the first. ``near_*``: the likeness of the
    fingerprint to that of the edited text and of the next document.

    Documents are sorted by id in ranges, a stream through each task; the last of a range meets the first of the
    next one in a second, small step (two documents a range). ``passes`` ranges of ids go one after the other, each with its own
    shuffle of whole texts, to hold less disk at once; it does not change the result.

    NULL texts are empty; NULL ids come first. Rows of equal ids follow each other in the order of a hash of the text, equal rows
    one after the other; each is a document. A single document is its own next. An empty text has an empty fingerprint.
    An empty table gives no row. Other columns are not returned, whatever their names.
    """
    spark, shelf = docs.sparkSession, common.Shelf(docs.sparkSession, "order-minhash")
    kind = docs.schema[id_column].dataType
    full = T.StructType([T.StructField("_id", kind), *T.StructType.fromDDL(f"{_MADE}, {_ENDS}").fields])
    short = T.StructType(full.fields[:-3])
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"))
    cuts = sorted(set(rows.agg(F.percentile_approx("_id", [(i + 1) / passes for i in range(passes - 1)], 1000)).first()[0] or [])) \
        if passes > 1 and isinstance(kind, T.NumericType) else []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = []
    for turn, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
        below = F.lit(True) if hi is None else F.col("_id") <= hi
        above = F.lit(True) if lo is None else F.col("_id") > lo
        chosen = rows.where(below & above if lo is not None else (below | F.col("_id").isNull()))
        # The row's number parts equal rows, which are one as good as the other.
        order = ["_id", "_hash", "_row"]
        ranged = chosen.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()}) \
            .repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_id", "_text")
        tables.append(shelf.put(ranged.mapInArrow(_streamed(full), full), f"pass-{turn}").withColumn("_turn", F.lit(turn)))
    done = tables[0]
    for other in tables[1:]:
        done = done.unionByName(other)
    spots = done.where("_first IS NOT NULL").select("_turn", "_part")  # a row per range
    follow = Window.orderBy("_turn", "_part")
    spot = F.struct("_turn", "_part")
    links = spots.select("_turn", "_part", F.coalesce(F.lead(spot).over(follow), F.first(spot).over(
        follow.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    firsts = done.where("_first IS NOT NULL").select(spot.alias("_to"), F.col("_first").alias("_after"))
    lasts = done.where("_last IS NOT NULL").select("_id", "_last", "_turn", "_part").join(links, ["_turn", "_part"]).join(firsts, "_to")
    ends = shelf.put(lasts.select("_id", "_last", "_after").mapInArrow(_joined(short), short), "ends")
    made = done.where("_last IS NULL").select(short.names).unionByName(ends)
    return made.withColumnRenamed("_id", id_column)
