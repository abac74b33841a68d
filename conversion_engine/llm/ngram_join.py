"""Documents whose word n-gram sets are nearly equal: a prefix-tree join of globally ordered sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conversion_engine.llm import common

#: A token's first 48 bits stand for it in counts. Equal ones share a place in the order, nothing else.
_COUNTED = np.uint64(16)


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text its distinct ``n``-word shingles as sorted 64-bit hashes; of fewer words the whole sequence."""
    words, bounds = common.hashed_words(texts, fold=True)
    grams = common.window_hashes(words, n)  # also across texts: those are not looked at
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= n:
            mine = np.sort(grams[low:high - n + 1])
            out.append(mine[np.concatenate([[True], mine[1:] != mine[:-1]])])
        elif high > low:
            # Short sequences are no shingles of longer texts: the length goes into the hash.
            out.append(common.mixed(common.window_hashes(words[low:high], high - low) + np.uint64(high - low)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(size: int, percent: int) -> int:
    """The least overlap of a set of ``size`` with any set similar enough."""
    return -(-percent * size // 100)


def ordered(grams: np.ndarray, common_tokens: np.ndarray) -> np.ndarray:
    """The set in the global order: common tokens after all others, each part by its hash."""
    if not len(common_tokens):
        return grams
    short = grams >> _COUNTED
    at = np.searchsorted(common_tokens, short)
    hot = common_tokens[np.minimum(at, len(common_tokens) - 1)] == short
    return np.concatenate([grams[~hot], grams[hot]])


def _sets_of(n: int, fn: Callable[[list[np.ndarray], pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """For mapInArrow over rows (key, text, ...): ``fn`` gets the shingle sets of a few MB of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            out = fn(gram_sets([t or b"" for t in part.column(1).to_pylist()], n), part)
            if out is not None:
                yield out
    return run


def _signatures(n: int) -> Callable:
    """(key, id, n_shingles, two sums of the set's hashes): equal sets have equal sums."""
    def fn(sets, part):
        sums = [[int(np.bitwise_xor.reduce(f(s))) if len(s) else 0 for s in sets]
                for f in (common.mixed, lambda s: common.mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
             *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in sums]], names=["_k", "_id", "_n", "_s1", "_s2"])
    return _sets_of(n, fn)


def _counts(n: int, buckets: int) -> Callable:
    """(bucket, tokens, counts): the short tokens of some texts with their document counts, by their top bits."""
    def fn(sets, part):
        tokens, counts = np.unique(np.concatenate(sets) >> _COUNTED, return_counts=True)
        edges = np.searchsorted(tokens, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(1 << 48) // np.uint64(buckets))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            token, count = tokens[edges[b]:edges[b + 1]], counts[edges[b]:edges[b + 1]]
            single = count == 1
            rows.append((int(b), _six(token[single]), _six(token[~single]), count[~single].astype("<u4").tobytes()))
        b, one, many, times = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(b, pa.int32()), pa.array(one, pa.binary()), pa.array(many, pa.binary()), pa.array(times, pa.binary())],
            names=["_b", "_one", "_many", "_times"])
    return _sets_of(n, fn)


def _six(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _frequent(least: int) -> Callable:
    """Tokens counted more than ``least`` times, from sorted rows of :func:`_counts`; a bucket at a time."""
    def total(ones: list[bytes], manys: list[bytes], times: list[bytes]) -> pa.RecordBatch:
        many = _unsix(b"".join(manys))
        token = np.concatenate([_unsix(b"".join(ones)), many])
        weight = np.concatenate([np.ones(len(token) - len(many), np.int64),
                                 np.frombuffer(b"".join(times), "<u4").astype(np.int64)])
        by = np.argsort(token, kind="stable")
        token, weight = token[by], weight[by]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sums = np.add.reduceat(weight, start) if len(start) else weight
        hot = sums > least
        return pa.RecordBatch.from_arrays([pa.array(token[start][hot].astype(np.int64))], names=["_token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            for b, *parts in zip(*[c.to_pylist() for c in batch.columns]):
                if b != now and now is not None:
                    yield total(*held)
                    held = ([], [], [])
                now = b
                for side, value in zip(held, parts):
                    side.append(value)
        if now is not None:
            yield total(*held)
    return run


def common_tokens(texts: DataFrame, n: int, least: int, shelf: common.Shelf) -> np.ndarray:
    """Tokens of more than ``least`` sets, so that there are fewer than all tokens' number divided by ``least``.

    Counts cover all sets; they travel packed, counted within each batch before.
    """
    buckets = 16 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = texts.mapInArrow(_counts(n, buckets), "_b int, _one binary, _many binary, _times binary")
    by_bucket = counts.repartition("_b").sortWithinPartitions("_b")
    rows = shelf.put(by_bucket.mapInArrow(_frequent(least), "_token long"), "common").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.uint64))


def _prefixes(n: int, percent: int, hot) -> Callable:
    """(key, token): the tokens of each set's prefix. Similar sets share one of them."""
    def fn(sets, part):
        tokens, keys = [], []
        for grams, key in zip(sets, part.column(0).to_pylist()):
            if len(grams):
                head = ordered(grams, hot.value)[: len(grams) - needed(len(grams), percent) + 1]
                tokens.append(head)
                keys.append(np.full(len(head), key, np.int64))
        if tokens:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(tokens).view(np.int64))], names=["_k", "_token"])
    return _sets_of(n, fn)


def bitmap(grams: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the set's tokens in each of ``bits`` places, as bytes.

    Two bitmaps of one width differ in at most as many places as the sets in tokens.
    """
    counts = np.bincount((grams % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


def width(size: int) -> int:
    """Bits of a set's bitmap, a power of two."""
    return max(64, 1 << (size - 1).bit_length())


def folded(bits: np.ndarray, to: int) -> np.ndarray:
    while len(bits) * 8 > to:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _sketches(n: int) -> Callable:
    """(key, size, bitmap)."""
    def fn(sets, part):
        return pa.RecordBatch.from_arrays([
            part.column(0), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([bitmap(s, width(len(s))).tobytes() for s in sets], pa.binary())], names=["_k", "_n", "_bits"])
    return _sets_of(n, fn)


def _sets(n: int, hot) -> Callable:
    """(key, component, the set in global order)."""
    def fn(sets, part):
        return pa.RecordBatch.from_arrays([
            part.column(0), part.column(2), pa.array([ordered(s, hot.value).tobytes() for s in sets], pa.binary())],
            names=["_k", "component", "_set"])
    return _sets_of(n, fn)


def similar(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


class Forest:
    """Disjoint sets of 0 .. n-1 with labels that numpy can compare."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.left = n
        self.links: list[tuple[int, int]] = []

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if self.label[a] != self.label[b]:
                self.label[self.label == self.label[b]] = self.label[a]
                self.links.append((a, b))
                self.left -= 1


def close(sizes: np.ndarray, bits: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and bitmaps do not rule out."""
    by = np.argsort(sizes, kind="stable")
    forest = Forest(len(by))
    for place, i in enumerate(by.tolist()):
        if forest.left == 1:
            break
        size = int(sizes[i])
        rest = by[place + 1:]
        rest = rest[(100 * size >= percent * sizes[rest]) & (forest.label[rest] != forest.label[i])]
        if not len(rest):
            continue
        mine = bits[i]
        other = np.stack([folded(bits[j], len(mine) * 8) for j in rest.tolist()])
        apart = np.bitwise_count(other ^ mine).sum(axis=1, dtype=np.int64)
        both = size + sizes[rest]
        # At similarity p the sets differ in at most (1 - p) / (1 + p) of their sizes' sum.
        forest.join(i, rest[(100 + percent) * apart <= (100 - percent) * both])
    return forest.links


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, by equal values of the first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _candidates(percent: int) -> Callable:
    """From sorted (token, key, size, bits) rows of small groups: edges (u, v) between sets worth a look."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for group in _grouped(batches, 1):
            if len(group) > 1:
                _, key, size, bits = zip(*group)
                for a, b in close(np.array(size), [np.frombuffer(x, np.uint8) for x in bits], percent):
                    u.append(key[a])
                    v.append(key[b])
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    return run


class Trie:
    """A compressed prefix tree of token sequences; one node holds the tokens up to the next fork.

    ``levels`` lists the nodes of each depth; ``low`` and ``high`` bound the sizes of the
    sets below a node, ``rest`` the most tokens that follow it.
    """

    def __init__(self, sets: list[np.ndarray]):
        by = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.leaf_of: list[list[int]] = []
        parent, start, end, owner = [], [], [], []  # tokens owner[start:end]
        path: list[int] = []  # the open nodes from the root

        def node(up: int, a: int, b: int, i: int) -> int:
            parent.append(up)
            start.append(a)
            end.append(b)
            owner.append(i)
            self.leaf_of.append([])
            return len(parent) - 1

        previous = None
        for i in by:
            tokens, same = sets[i], 0
            if previous is not None:
                m = min(len(tokens), len(previous))
                apart = np.flatnonzero(tokens[:m] != previous[:m])
                same = int(apart[0]) if len(apart) else m
            while path and start[path[-1]] >= same:
                path.pop()
            if path and end[path[-1]] > same:  # split: the upper part becomes the fork
                lower = path.pop()
                fork = node(parent[lower], start[lower], same, owner[lower])
                parent[lower], start[lower] = fork, same
                path.append(fork)
            if len(tokens) > same or not path:
                path.append(node(path[-1] if path else -1, same, len(tokens), i))
            self.leaf_of[path[-1]].append(i)
            previous = tokens
        self.parent, self.start, self.end = map(np.array, (parent, start, end))
        n = len(parent)
        self.low, self.high = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        children: list[list[int]] = [[] for _ in range(n)]
        roots = []
        for k in range(n):
            (children[parent[k]] if parent[k] >= 0 else roots).append(k)
        level, self.levels = roots, []
        while level:
            self.levels.append(np.array(level))
            level = [c for k in level for c in children[k]]
        for nodes in reversed(self.levels):
            for k in nodes.tolist():
                own = [len(sets[i]) for i in self.leaf_of[k]]
                self.low[k] = min([*own, *[self.low[c] for c in children[k]]])
                self.high[k] = max([*own, *[self.high[c] for c in children[k]]])
        self.tokens = np.concatenate([sets[o][a:b] for o, a, b in zip(owner, start, end)])
        self.offset = np.concatenate([[0], np.cumsum(self.end - self.start)])

    def overlaps(self, probe: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """(node with leaves, overlap of its path with ``probe``) wherever no bound rules it out.

        The overlap of a path is counted once for all sets below it. A subtree goes when even
        all tokens that may follow cannot reach the overlap its smallest set would need, or
        when its sets are all too small or too large.
        """
        size, found = len(probe), []
        total = np.zeros(len(self.parent), np.int64)
        open_ = np.zeros(len(self.parent), bool)
        for depth, nodes in enumerate(self.levels):
            if depth:
                nodes = nodes[open_[self.parent[nodes]]]
            if not len(nodes):
                break
            lengths = (self.end - self.start)[nodes]
            first = np.concatenate([[0], np.cumsum(lengths)])
            at = np.repeat(self.offset[nodes] - first[:-1], lengths) + np.arange(first[-1])
            tokens = self.tokens[at]
            place = np.minimum(np.searchsorted(probe, tokens), size - 1)
            hits = np.concatenate([[0], np.cumsum(probe[place] == tokens)])
            above = total[self.parent[nodes]] if depth else 0
            sums = above + hits[first[1:]] - hits[first[:-1]]
            total[nodes] = sums
            low, high = self.low[nodes], self.high[nodes]
            reach = sums + np.minimum(high - self.end[nodes], size - sums)
            # overlap >= p / (100 + p) (a + b), with the smallest b below the node
            alive = ((100 + percent) * reach >= percent * (size + low)) \
                & (100 * np.minimum(size, high) >= percent * np.maximum(size, low))
            open_[nodes] = alive
            found += [(k, s) for k, s in zip(nodes[alive].tolist(), sums[alive].tolist()) if self.leaf_of[k]]
        return found


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that are similar enough."""
    forest = Forest(len(sets))
    trie = Trie(sets)
    sizes = np.array([len(s) for s in sets])
    for i in range(len(sets)):
        if forest.left == 1 or (forest.label == forest.label[i]).all():
            break
        near = [j for node, overlap in trie.overlaps(np.sort(sets[i]), percent) for j in trie.leaf_of[node]
                if j != i and similar(overlap, int(sizes[i]), int(sizes[j]), percent)]
        forest.join(i, np.array(near, np.int64))
    return forest.links


def _verified(percent: int) -> Callable:
    """From sorted (component, low block, high block, key, set) rows: edges (u, v) between similar sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            keys = [r[3] for r in group]
            found = links([np.frombuffer(r[4], np.uint64) for r in group], percent) if len(group) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in found], pa.int64()),
                                                  pa.array([keys[b] for _, b in found], pa.int64())], names=["u", "v"])
    return run


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_column: str = "doc_id",
                       text_column: str = "text", **limits: int) -> DataFrame:
    """(``id_column``, n_shingles, component_id, representative): groups of texts with similar shingle sets.

    Words are separated by ASCII white space, A-Z lower-cased; a text's set is its distinct
    ``n``-word shingles (the whole sequence if it is shorter). Two rows link when the intersection has at least
    ``percent`` hundredths of the union. ``component_id`` is the smallest id reachable by links,
    ``representative`` is true for the row of that id (rows equal in id and text share it).

    1. Equal sets become one. 2. Tokens get a global order, common ones last. 3. Similar sets share a token
    of their prefixes in this order; groups of sets with such a token are cut down by sizes and by bitmaps,
    whose distance is a lower bound of the sets'. A group of a common token (only sets that are nearly all common
    tokens have them in the prefix) is tied together as it is. 4. Each connected group of candidates goes
    to one task (very large ones in pairs of blocks of ``block_bytes``), which stores the ordered sets in
    a prefix tree and traverses it. 5. The links found form the groups. Nothing is capped; hashes of 64 bits
    stand for shingles and rows.

    NULL and empty texts have an empty set and are alone. NULL ids are smaller than no id: a group's
    component_id is the smallest id that is not NULL, and NULL if there is none. Repeated rows are in one group.
    Other columns are ignored. An empty table gives no row.
    """
    return _joined(docs, n, percent, id_column, text_column, **limits).select(
        F.col("_id").alias(id_column), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"),
        "representative")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
                **limits: int) -> DataFrame:
    """One row of each group of :func:`jaccard_components`, all columns: that of the smallest id.

    Of rows equal in id and text one stays, with or without words.
    """
    name = common.fresh(docs, "_k")
    chosen = _joined(docs, n, percent, id_column, text_column, **limits).where("representative") \
        .select(F.col("_k").alias(name)).distinct()
    keyed = docs.withColumn(name, common.row_key(id_column, text_column)[0])
    return keyed.join(chosen, name, "left_semi").dropDuplicates([name]).drop(name)


def _joined(docs: DataFrame, n: int, percent: int, id_column: str, text_column: str, group: int = 64,
            most_common: int = 1 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """(_k, _id, _n, _component, representative): the work of :func:`jaccard_components`, with the rows' keys."""
    spark = docs.sparkSession
    shelf = common.Shelf(spark, "ngram-join")
    key = common.row_key(id_column, text_column)[0].alias("_k")
    body = F.col(f"`{text_column}`").cast("binary").alias("_text")
    texts = docs.select(key, body)
    schema = T.StructType().add("_k", "long").add("_id", docs.schema[id_column].dataType) \
        .add("_n", "long").add("_s1", "long").add("_s2", "long")
    signed = shelf.put(docs.select(key, body, F.col(f"`{id_column}`").alias("_id")).mapInArrow(_signatures(n), schema),
                       "signed")
    classes = signed.where("_n > 0").groupBy("_n", "_s1", "_s2").agg(
        F.min("_k").alias("_class"), F.max("_k").alias("_last"))
    repeats = shelf.put(classes.where("_class != _last").join(signed, ["_n", "_s1", "_s2"]).where("_k != _class")
                        .select("_k").union(signed.where("_n = 0").select("_k")), "repeats")
    twice = shelf.put(signed.groupBy("_k").agg(F.count("*").alias("_c")).where("_c > 1").select("_k"), "twice")
    first = texts.join(repeats, "_k", "left_anti")
    alone = first.join(twice, "_k", "left_anti").union(first.join(twice, "_k", "left_semi").dropDuplicates(["_k"]))
    total = classes.agg(F.sum("_n")).first()[0] or 0
    # A token of more sets is common. There are fewer than ``most_common`` such tokens, the bound of what is sent around.
    least = max(group, total // most_common)
    hot = spark.sparkContext.broadcast(common_tokens(alone, n, least, shelf))

    prefixes = shelf.put(alone.mapInArrow(_prefixes(n, percent, hot), "_k long, _token long"), "prefixes")
    shared = prefixes.groupBy("_token").agg(F.min("_k").alias("_a"), F.max("_k").alias("_b"),
                                            F.count("*").alias("_c")).where("_a != _b")
    members = shelf.put(prefixes.join(shared.select("_token", "_a", (F.col("_c") <= least).alias("_small")), "_token"), "members")
    shelf.drop("prefixes")
    wanted = members.where("_small").select("_k").distinct()
    sketches = shelf.put(alone.join(wanted, "_k", "left_semi").mapInArrow(_sketches(n), "_k long, _n long, _bits binary"),
                         "sketches")
    small = members.where("_small").select("_token", "_k").join(sketches, "_k") \
        .select("_token", "_k", "_n", "_bits").repartition("_token").sortWithinPartitions("_token")
    tied = small.mapInArrow(_candidates(percent), "u long, v long") \
        .union(members.where("NOT _small AND _k != _a").select(F.col("_k").alias("u"), F.col("_a").alias("v")))
    groups = common.components(tied, shelf)
    shelf.drop("members")
    shelf.drop("sketches")
    grouped = groups.select(F.col("node").alias("_k"), "component")
    rows = shelf.put(alone.join(grouped, "_k").select("_k", "_text", "component").mapInArrow(
        _sets(n, hot), "_k long, component long, _set binary"), "sets")
    blocks = rows.groupBy("component").agg(F.sum(F.length("_set")).alias("_bytes")) \
        .select("component", F.ceil(F.col("_bytes") / block_bytes).cast("int").alias("_blocks"))
    mine = F.pmod(F.hash("_k"), F.col("_blocks"))
    dealt = rows.join(blocks, "component").withColumn("_mine", mine).withColumn(
        "_other", F.explode(F.when(F.col("_blocks") == 1, F.array(F.lit(0)))
                            .otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1)))) \
        .select("component", F.least("_mine", "_other").alias("_low"), F.greatest("_mine", "_other").alias("_high"),
                "_k", "_set")
    parts = ["component", "_low", "_high"]
    found = dealt.repartition(*parts).sortWithinPartitions(*parts).mapInArrow(_verified(percent), "u long, v long")
    linked = common.components(found, shelf)

    named = signed.join(classes.select("_n", "_s1", "_s2", "_class"), ["_n", "_s1", "_s2"], "left") \
        .join(linked.select(F.col("node").alias("_class"), "component"), "_class", "left") \
        .select("_id", "_n", "_k", F.coalesce("component", "_class", "_k").alias("_group"))
    # A row without words is alone, even beside an equal one.
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_k")).alias("_first")
    chosen = named.where("_n > 0").groupBy("_group").agg(first)
    empty = F.col("_n") == 0
    result = named.join(chosen, "_group", "left").select(
        "_k", "_id", "_n", F.when(empty, F.col("_id")).otherwise(F.col("_first._id")).alias("_component"),
        (empty | (F.col("_k") == F.col("_first._k"))).alias("representative"))
    stored = shelf.put(result, "result")
    shelf.keep("result")
    return stored
