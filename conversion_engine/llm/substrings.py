"""Passages of many words that repeat anywhere in the corpus, found by level-wise doubling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conversion_engine.llm import common

def levels(window: int, shortest: int = 8) -> list[int]:
    """Lengths from about ``shortest`` words to ``window``, each at most twice the one before."""
    out = [window]
    while out[0] >= 2 * shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def anchors(hashes: np.ndarray, length: int, window: int) -> np.ndarray:
    """For every window, the place of the ``length``-word run in it with the smallest hash.

    Equal windows have equal runs, so they choose the same one: the runs chosen are
    enough to tell which windows can repeat, and they are a small share of all runs.
    """
    runs = common.window_hashes(hashes, length)
    width = window - length + 1
    if width == 1:
        return np.arange(len(runs))
    return sliding_window_view(runs, width).argmin(axis=1) + np.arange(len(runs) - width + 1)


def survivors(hashes: np.ndarray, lengths: list[int], kept: np.ndarray | None, window: int) -> np.ndarray:
    """Starts of the windows that can still repeat: those whose run of the last level did.

    ``kept`` are the repeated runs of the last level, found among the windows that
    earlier levels left; runs of other windows may share a place with them, which only
    keeps a window longer than needed.
    """
    if kept is None:
        return np.arange(max(0, len(hashes) - window + 1))
    chosen = anchors(hashes, lengths[-1], window)
    return np.flatnonzero(np.isin(chosen, kept))


def _emit(window: int, lengths: list[int]) -> Callable:
    """Rows (hash, more bits of a hash, key, place) of the runs of ``lengths[-1]`` words to be counted.

    64 bits are enough to rule runs out; whole windows have 96.
    """
    length, before = lengths[-1], lengths[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            key = part.column(0).to_numpy()
            words, bounds = common.hashed_words([t or b"" for t in part.column(1).to_pylist()])
            found = part.column(2) if before else None
            first, second, rows, places = [], [], [], []
            for i in range(part.num_rows):
                hashes = words[bounds[i]:bounds[i + 1]]
                kept = found[i].values.to_numpy() if before else None
                starts = survivors(hashes, before, kept, window)
                if len(starts):
                    at = np.unique(anchors(hashes, length, window)[starts])
                    first.append(common.window_hashes(hashes, length)[at])
                    if length == window:
                        second.append(common.window_hashes(hashes, length, 0xD6E8FEB86659FD93)[at] >> np.uint64(33))
                    places.append(at)
                    rows.append(np.full(len(at), i))
            if rows:
                row = np.concatenate(rows)
                more = np.concatenate(second).astype(np.int32) if second else np.zeros(len(row), np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(first).view(np.int64)), pa.array(more), pa.array(key[row]),
                    pa.array(np.concatenate(places).astype(np.int32))], names=["_h", "_h2", "_k", "_at"])
    return run


def repeated(source: DataFrame, window: int, shelf: common.Shelf) -> DataFrame:
    """(_k, _starts): the starts of windows whose words also start anywhere else; ``source`` has (_k, _text), keys distinct.

    Level by level, runs are counted across the corpus and those found once drop out;
    only windows around the rest are looked at with runs of twice the length, and with
    whole windows at last. Counts are partial aggregates; a run in very many documents is
    one row of the counts. These are stored before the join back to the places, so that a partition that one
    run fills is split there: adaptive execution splits no side that an aggregate has yet to make.
    """
    found, lengths = None, []
    for length in levels(window):
        lengths.append(length)
        rows = source if found is None else source.join(found, "_k")
        name = f"runs{length}"
        runs = shelf.put(rows.mapInArrow(_emit(window, list(lengths)), "_h long, _h2 int, _k long, _at int"), name)
        shared = shelf.put(runs.groupBy("_h", "_h2").agg(F.count("*").alias("_c")).where("_c > 1").select("_h", "_h2"), f"shared{length}")
        places = runs.join(shared, ["_h", "_h2"], "left_semi")
        found = shelf.put(places.groupBy("_k").agg(F.array_sort(F.collect_list("_at")).alias("_starts")), f"found{length}")
        shelf.drop(name)
        shelf.drop(f"shared{length}")
        if len(lengths) > 1:
            shelf.drop(f"found{lengths[-2]}")
    return found


def _cut(window: int, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            texts, found = part.column(1).to_pylist(), part.column(2)
            kept, sizes, gone = [], [], []
            for i, text in enumerate(texts):
                words = (text or b"").split()
                sizes.append(len(words))
                if found[i].is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    starts = found[i].values.to_numpy()
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    gone.append(len(words) - len(stay))
                    words = [words[j] for j in stay]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())],
                names=[name, "text", "n_words", "n_removed"])
    return run


def dedup_substrings(docs: DataFrame, window: int = 35, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """(``id_column``, text, n_words, n_removed): texts without their repeated passages.

    A word goes if it lies in a window of ``window`` consecutive words whose words, as
    they are, also start at another place, of the same document or another. Windows are
    judged on the input. The words left are joined by one space. Windows are compared by
    96 bits of hash, rows by 64.

    NULL texts have no words. Rows equal in id and text are one document, given as often
    as they occur. Texts shorter than a window stay. Other columns are ignored. An
    empty table gives no row.
    """
    shelf = common.Shelf(docs.sparkSession, "substrings")
    named = docs.select(F.col(f"`{id_column}`").alias("_id"), common.row_key(id_column, text_column)[0].alias("_k"),
                        F.col(f"`{text_column}`").cast("binary").alias("_text"))
    texts = named.select("_k", "_text")
    twice = shelf.put(texts.groupBy("_k").agg(F.count("*").alias("_c")).where("_c > 1").select("_k"), "twice")
    source = texts.join(twice, "_k", "left_anti").union(texts.join(twice, "_k", "left_semi").dropDuplicates(["_k"]))
    found = repeated(source, window, shelf)
    shelf.keep(f"found{window}")
    joined = named.join(found, "_k", "left").select("_id", "_text", "_starts")
    schema = docs.select(f"`{id_column}`").schema.add("text", "string").add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(_cut(window, id_column), schema)
