"""Order-preserving packing of token streams by dynamic programming with a monotone queue."""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from conversion_engine.llm import common

#: A cached chunk costs some 200 bytes of a Python worker.
CACHED_CHUNKS = 400_000
_UNSAFE = re.compile(r"\s |\s\Z")


class ChunkTokenizer:
    """Byte-level BPE ids of a text, from a cache of its space-separated chunks.

    A space that follows no white space always begins a new piece of the
    tokenizer's pattern, so chunks of such texts can be encoded one by one; texts
    with runs of white space are encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: By id: does the token end a sentence?
        self.ends = np.zeros(max(ranks.values()) + 2, bool)
        self.ends[[i for token, i in ranks.items() if token[-1:] in b".!?\n"]] = True
        encode = self.bpe.encode_ordinary

        class Cache(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = np.array(encode(chunk), "<u4").tobytes()
                if len(self) < CACHED_CHUNKS and len(chunk) < 64:
                    self[chunk] = ids
                return ids

        self.cache = Cache()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNSAFE.search(text):
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        get = self.cache.__getitem__
        return get(first) + b"".join([get(" " + c) for c in rest])


def cuts(ends: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indexes into ``ends`` where windows end; the last one is always among them.

    ``ends`` are rising candidate positions at most ``length`` apart (the first at
    most ``length``), each with the penalty of ending a window there. The sum of
    padding and penalties is minimal. With g(i) = cost(i) + ends(i), the best cost
    at j is penalty(j) + length - ends(j) + min g(i) over the positions within
    ``length`` before it: a sliding minimum, kept in a queue of rising g.
    """
    at, pen = ends.tolist(), penalties.tolist()
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # position, g, index
    back = [0] * len(at)
    for j, end in enumerate(at):
        low = end - length
        while queue[0][0] < low:
            queue.popleft()
        _, g, i = queue[0]
        back[j] = i
        g += pen[j] + length  # cost(j) + end
        while queue and queue[-1][1] >= g:
            queue.pop()
        queue.append((end, g, j))
    out, j = [], len(at) - 1
    while j >= 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, length: int, stride: int,
               sentence_penalty: int, middle_penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and their penalties.

    After documents (no penalty), after sentences, and every ``stride`` tokens
    (a cut within a sentence).
    """
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[stride::stride] = middle_penalty
    cost[1:][sentence_end[ids]] = sentence_penalty
    cost[doc_ends] = 0
    cost[len(ids)] = max(cost[len(ids)], 0)
    cost[0] = -1
    ends = np.flatnonzero(cost >= 0)
    return ends, cost[ends]


def pack(docs: DataFrame, ranks_path: str, pattern: str, length: int = 1024, end_id: int = 0,
         sentence_penalty: int = 2, middle_penalty: int = 24, stride: int = 64, run_tokens: int = 1 << 18,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens, in the order of the input.

    Every document's ids (closed by ``end_id``) follow each other as in the input;
    the stream of a partition is cut into windows so that padding plus penalties
    is least: nothing for a cut after a document, ``sentence_penalty`` within
    one, ``middle_penalty`` within a sentence. One row per piece:
    ``id_column``, start (ids of its document before it), length, ids (bytes, little-endian
    32 bit), doc_tokens, sequence_id, offset (in the sequence).

    No shuffle: partitions are packed one by one, in runs of ``run_tokens``
    tokens with the last window carried on, so a task holds one run or one document. Each partition may
    leave one short window.

    NULL and empty texts are the end id alone. Rows with a NULL or repeated id
    are documents of their own. An empty table gives no row. Other columns are ignored.
    """
    schema = docs.select(f"`{id_column}`").schema.add("start", "long").add("length", "long").add("ids", "binary") \
        .add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ChunkTokenizer(ranks_path, pattern)
        tail = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        # Documents not yet packed: id, ids already packed, ids of the document in all, bytes left.
        held: list[tuple] = []
        held_bytes = 0

        def emit(last: bool):
            nonlocal held, held_bytes, sequence
            data = b"".join(h[3] for h in held)
            ids = np.frombuffer(data, "<u4")
            doc_ends = np.cumsum([len(h[3]) // 4 for h in held])
            ends, costs = candidates(ids, doc_ends, tokens.ends, length, stride, sentence_penalty, middle_penalty)
            windows = ends[cuts(ends, costs, length)]
            if not last:
                windows = windows[:-1]
            done = int(windows[-1]) if len(windows) else 0
            edges = np.union1d(windows, doc_ends[doc_ends <= done])
            starts = np.concatenate([[0], edges[:-1]]).astype(np.int64)[: len(edges)]
            doc = np.searchsorted(doc_ends, starts, side="right")
            win = np.searchsorted(windows, starts, side="right")
            doc_start = np.concatenate([[0], doc_ends[:-1]])[doc]
            win_start = np.concatenate([[0], windows[:-1]])[win] if len(edges) else win
            out = pa.RecordBatch.from_arrays([
                pa.array([held[d][0] for d in doc], type=id_type),
                pa.array(starts - doc_start + np.array([held[d][1] for d in doc], np.int64)),
                pa.array(edges - starts),
                pa.array([data[4 * a:4 * b] for a, b in zip(starts.tolist(), edges.tolist())], type=pa.binary()),
                pa.array(np.array([held[d][2] for d in doc], np.int64)),
                pa.array(sequence + win),
                pa.array(starts - win_start),
            ], names=schema.names)
            sequence += len(windows)
            first = int(np.searchsorted(doc_ends, done, side="right"))
            left = held[first:]
            if left:
                name, before, total, body = left[0]
                gone = done - (int(doc_ends[first - 1]) if first else 0)
                left[0] = (name, before + gone, total, body[4 * gone:])
            held, held_bytes = left, len(data) - 4 * done
            return out

        id_type = None
        for part in common.slices(batches, rows=512):
            id_type = part.column(0).type
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                body = tokens(text) + tail
                held.append((name, 0, len(body) // 4, body))
                held_bytes += len(body)
                if held_bytes >= 4 * run_tokens:
                    yield emit(last=False)
        if held:
            yield emit(last=True)

    return docs.select(f"`{id_column}`", f"`{text_column}`").mapInArrow(run, schema)
