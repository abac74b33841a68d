"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie in joins.

The trie is a table of edges. A node is a prefix, by hash; only nodes where words part or end are kept, so an
edge's label may have many letters. A state (word, position, node, edits) has read the first letters of its
word on the way from the root to its node. Each round joins all states with the edges of their nodes; a state goes on
where the label agrees with its word. It has its edit at a node where another letter goes on, and must agree
from there; at the end of another word it has found a neighbour.

One edit leaves the first or the last half of a word alone. Words stand in the trie from both sides, and states
start behind the half that is alike, where few words share a node.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conversion_engine.llm import common

_SIDES = np.array([0x51ED270B, 0x7FB5D329], np.uint64)
_DEPTH = np.uint64(0xD6E8FEB86659FD93)


def _counter(least: int, every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of words, as each task finds them."""
    letters = re.compile("[a-z\u00C0-\u00FF]{%d,}" % max(1, least))

    def flushed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in common.slices(batches):
            for key, text in zip(batch.column("_id").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist()):
                if text is None:
                    continue
                found = letters.findall(text.lower().decode())  # bytes.lower() changes A-Z alone
                counts.update(found)
                start = crc32(f"{'' if key is None else key}:".encode())
                marks = np.fromiter(map(crc32, map(str.encode, found), repeat(start)), np.uint32, len(found))
                for i in np.flatnonzero(marks % every == 0):
                    word = found[i]
                    counts[word] -= 1
                    at = int(marks[i]) % len(word)
                    if len(word) > least:
                        counts[word[:at] + word[at + 1:]] += 1
            if len(counts) > 1 << 18:
                yield flushed(counts)
                counts = Counter()
        if counts:
            yield flushed(counts)
    return run


def word_counts(docs: DataFrame, least: int = 7, every: int = 31, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word``, ``n``: the corpus's words and how often they occur.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case; a run whose CRC-32 of "id:run" ``every``
    divides loses one code point, that number's modulo its length. Words of less than ``least`` code points are left out.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("string").alias("_id"), F.col(f"`{text_column}`").alias("_text"))
    parts = rows.mapInArrow(_counter(least, every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0 AND word <> ''")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, side, depth, node, next, after, left): the second half of each word's prefixes, read from either side.

    ``next`` and ``after`` are the code points that follow, 0 beyond the end; ``left`` letters do. All words of a batch are worked
    on together, in time linear in letters.
    """
    for batch in common.slices(batches, 1 << 20, 4096):
        ids = batch.column("_w").to_numpy()
        words = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in batch.column("word").to_pylist()]
        for side in (0, 1):
            letters = np.concatenate([np.append(w if not side else w[::-1], 0) for w in words]).astype(np.uint64)
            size = np.array([len(w) + 1 for w in words])
            start = np.cumsum(size) - size
            depth = np.arange(len(letters)) - np.repeat(start, size)
            powers = common._places(1 << int(size.max()).bit_length())
            terms = common.mixed(letters + np.uint64(1)) * powers[depth]
            sums = np.cumsum(terms) - terms
            sums -= np.repeat(sums[start], size)
            node = common.mixed(sums + depth.astype(np.uint64) * _DEPTH + _SIDES[side])
            half = depth >= np.repeat((size - 2) // 2, size)
            yield pa.RecordBatch.from_pydict({
                "_w": pa.array(np.repeat(ids, size)[half]), "_side": pa.array(np.full(int(half.sum()), side, np.int32)),
                "_d": pa.array(depth[half].astype(np.int32)), "_node": pa.array(node[half].view(np.int64)),
                "_next": pa.array(letters[half].astype(np.int32)),
                "_after": pa.array(np.where(letters == 0, 0, np.append(letters[1:], 0))[half].astype(np.int32)),
                "_left": pa.array((np.repeat(size - 1, size) - depth)[half].astype(np.int32))})


def _letters(word: str, side: str) -> Column:
    return F.when(F.col(side) == 0, F.col(word)).otherwise(F.reverse(F.col(word)))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _letter_bit(code: Column) -> Column:
    """One of 64 bits for a code point; letters may share one."""
    return _bit(code.bitwiseAND(63))


def _length_bit(letters: Column) -> Column:
    """One of 64 bits for a number of letters; 63 and more share the last."""
    return _bit(F.least(letters, F.lit(63)))


def trie(words: DataFrame, shelf: common.Shelf) -> tuple[DataFrame, DataFrame]:
    """The branching nodes on each word's way (_w, _side, _d, _node, _next, _after), and the edges (_node, _letter, _label, _to, _end,
    _goes, _ends).

    ``_end`` is the word that ends where the edge leads, if one does; ``_letter`` is the label's first code point. The bits of
    ``_goes`` are the letters that go on from there, those of ``_ends`` the numbers of letters after which words end.
    """
    schema = "_w long, _side int, _d int, _node long, _next int, _after int, _left int"
    prefixes = shelf.put(words.select("_w", "word").mapInArrow(_prefixes, schema), "prefixes")
    # Stored before it is joined, so that a node with very many words can be split.
    next_, left = F.col("_next"), F.col("_left")
    forks = shelf.put(prefixes.groupBy("_node").agg(
        F.min("_next").alias("_a"), F.max("_next").alias("_b"), F.bit_or(F.when(next_ > 0, _letter_bit(next_)).otherwise(0)).alias("_goes"),
        F.bit_or(_length_bit(left)).alias("_ends")).where("_a < _b").select("_node", "_goes", "_ends"), "forks")
    stops = shelf.put(prefixes.join(forks, "_node", "left").where("_goes IS NOT NULL OR _next = 0")
                      .select("_w", "_side", "_d", "_node", "_next", "_after", "_goes", "_ends"), "stops")
    shelf.drop("prefixes")
    shelf.drop("forks")
    ways = stops.groupBy("_w", "_side").agg(
        F.array_sort(F.collect_list(F.struct("_d", "_node", "_next", "_goes", "_ends"))).alias("_stops"))
    steps = ways.join(words.select("_w", "word"), "_w").select(
        "_w", _letters("word", "_side").alias("_s"),
        F.explode(F.zip_with(F.slice("_stops", F.lit(1), F.size("_stops") - 1), F.slice("_stops", F.lit(2), F.size("_stops")),
                             lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("_e"))
    size = F.col("_e.b._d") - F.col("_e.a._d")
    edges = steps.select(F.col("_e.a._node").alias("_node"), F.col("_e.a._next").alias("_letter"),
                         F.substring("_s", F.col("_e.a._d") + 1, size).alias("_label"), F.col("_e.b._node").alias("_to"),
                         F.when(F.col("_e.b._next") == 0, F.col("_w")).alias("_end"),
                         F.coalesce("_e.b._goes", F.lit(0).cast("long")).alias("_goes"),
                         F.coalesce("_e.b._ends", F.lit(1).cast("long")).alias("_ends"))
    edges = shelf.put(edges.groupBy("_node", "_letter", "_label", "_to").agg(
        F.max("_end").alias("_end"), F.max("_goes").alias("_goes"), F.max("_ends").alias("_ends")), "edges")
    return stops.where("_goes IS NOT NULL").select("_w", "_side", "_d", "_node", "_next", "_after"), edges


def _alive(position: Column, code: Column | None = None) -> Column:
    """May a state at the end of an edge still end in a word? By the next letter (``code``) and the number of letters left."""
    left = F.col("_n") - position
    code = F.ascii(F.substring("_s", position + 1, F.lit(1))) if code is None else code
    goes = F.col("_goes").bitwiseAND(_letter_bit(code)) != 0
    ends = F.col("_ends").bitwiseAND(_length_bit(F.greatest(left, F.lit(0)))) != 0
    return ((left == 0) & F.col("_end").isNotNull()) | ((left > 0) & ends & goes)


def one_edit_pairs(words: DataFrame, shelf: common.Shelf) -> DataFrame:
    """(_w, _v): numbers of words (_w, word) that lie one inserted, deleted or replaced code point apart, both ways round.

    A replacement is found from the word with the smaller code point, an insertion from the shorter word. Nodes are hashes, so
    what a state claims about the other word is compared with that word at the end.
    """
    stops, edges = trie(words, shelf)
    texts = words.select("_w", "word", F.length("word").alias("_n"))
    half = F.floor(F.col("_n") / 2)
    begin = stops.join(texts, "_w").where(F.col("_d") >= F.when(F.col("_side") == 0, half).otherwise(F.col("_n") - half)).select(
        "_w", "_side", "_n", "_d", "_node", "_next", "_after", _letters("word", "_side").alias("_s"))
    met = begin.join(edges, "_node").where("_letter != _next")
    size, d = F.length("_label"), F.col("_d")
    short = size == 1  # most labels; their states need no look at the text
    rest = F.substring("_label", F.lit(2), size)

    def fits(start: Column, code: str) -> Column:
        """Does the label agree with the word from ``start`` on, but for the label's first letter? And may the word end below?"""
        text = short | (F.substring("_s", start + 1, size - 1) == rest)
        end = start + size - 1
        return _alive(end, F.when(short, F.col(code)).otherwise(F.ascii(F.substring("_s", end + 1, F.lit(1))))) & text
    replaced = (F.col("_next") != 0) & (F.col("_letter") > F.col("_next")) & fits(d + 1, "_after")
    inserted = fits(d, "_next")
    met = met.withColumns({"_replaced": replaced, "_inserted": inserted}).where("_replaced OR _inserted")
    edit = F.explode(F.array_compact(F.array(
        F.when(F.col("_replaced"), F.struct(F.lit(1).alias("skip"), (d + size).alias("i"))),
        F.when(F.col("_inserted"), F.struct(F.lit(0).alias("skip"), (d + size - 1).alias("i"))))))
    head = ["_w", "_side", "_n", "_s", "_d", "_c"]
    state = met.withColumn("_edit", edit).select(
        "_w", "_side", "_n", "_s", "_d", F.substring("_label", F.lit(1), F.lit(1)).alias("_c"), F.col("_edit.skip").alias("_skip"),
        F.col("_edit.i").alias("_i"), F.col("_to").alias("_node"), "_end")
    state = shelf.put(state, "states-0")
    found, turn = [], 0
    while True:
        at_end = state.where("_i = _n AND _end IS NOT NULL").select(*head, "_skip", "_end")
        found.append(shelf.put(at_end, f"found-{turn}"))
        walked = state.where("_i < _n").select(*head, "_skip", "_i", "_node").join(
            edges.drop("_letter"), "_node").where(F.substring("_s", F.col("_i") + 1, F.length("_label")) == F.col("_label")) \
            .where(_alive(F.col("_i") + F.length("_label")))
        turn += 1
        state = shelf.put(walked.select(*head, "_skip", (F.col("_i") + F.length("_label")).alias("_i"), F.col("_to").alias("_node"),
                                        "_end"), f"states-{turn}")
        shelf.drop(f"states-{turn - 1}")
        if state.isEmpty():
            break
    ends = found[0]
    for other in found[1:]:
        ends = ends.union(other)
    other = texts.select(F.col("_w").alias("_end"), F.col("word").alias("_other"))
    claimed = F.concat(F.substring("_s", F.lit(1), F.col("_d")), F.col("_c"), F.substring("_s", F.col("_d") + F.col("_skip") + 1, F.col("_n")))
    right = ends.join(other, "_end").where(claimed == _letters("_other", "_side")).select("_w", F.col("_end").alias("_v"))
    pairs = shelf.put(right.union(right.select("_v", "_w")).distinct(), "pairs")
    shelf.keep("words", "pairs")
    return pairs


def last_forms(forms: DataFrame, shelf: common.Shelf) -> DataFrame:
    """(_w, _root): where the forms (_w, _form) lead in the end, by pointers of doubling length.

    A form is at least so much more frequent than its word that ways are short and never closed.
    """
    name, turn = "ways-0", 0
    ways = shelf.put(forms.select("_w", F.col("_form").alias("_root")), name)
    while True:
        onward = ways.select(F.col("_w").alias("_root"), F.col("_root").alias("_far"))
        longer = ways.join(onward, "_root", "left")
        if longer.where("_far IS NOT NULL").isEmpty():
            return ways
        turn += 1
        last, name = name, f"ways-{turn}"
        ways = shelf.put(longer.select("_w", F.coalesce("_far", "_root").alias("_root")), name)
        shelf.drop(last)


def group_variants(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """Words (``word``, ``n``) with their forms: word, form, root, n, n_near, form_n.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of the largest
    ``n`` (ties: the smallest in code-point order) if that is at least ``ratio`` (more than 1) times its own; the root is the last form reached from
    it, or the word itself. ``n_near`` counts near words.

    NULL words drop out; words must be distinct. No word gives an empty table. Other columns are not returned.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    shelf = common.Shelf(counts.sparkSession, "spelling")
    words = shelf.put(counts.where("word IS NOT NULL").select(
        F.monotonically_increasing_id().alias("_w"), "word", F.col("n").cast("long").alias("n")), "words")
    pairs = one_edit_pairs(words, shelf)
    near = pairs.join(words.select(F.col("_w").alias("_v"), F.col("word").alias("_near"), F.col("n").alias("_m")), "_v")
    best = near.groupBy("_w").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("_m"), "_near", "_v")).alias("_best"))
    known = words.join(best.select("_w", "n_near", -F.col("_best.col1"), "_best._near", "_best._v").toDF(
        "_w", "n_near", "_m", "_near", "_v"), "_w", "left")
    formed = F.col("_m") >= F.lit(ratio) * F.col("n")
    known = shelf.put(known.select("_w", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(formed, F.col("_near")).alias("form"), F.when(formed, F.col("_m")).alias("form_n"),
                                   F.when(formed, F.col("_v")).alias("_form")), "known")
    ways = last_forms(known.where("_form IS NOT NULL").select("_w", "_form"), shelf)
    names = words.select(F.col("_w").alias("_root"), F.col("word").alias("root"))
    roots = shelf.put(ways.join(names, "_root").select("_w", "root"), "roots")
    shelf.keep("known", "roots")
    return known.join(roots, "_w", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = 7, times: int = 2, ratio: int = 10, every: int = 31,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``group_variants`` of the corpus's words: those of at least ``least`` code points that occur ``times`` times or more.

    NULL and empty texts have no words; a NULL id counts as an empty one in the CRC-32; repeated rows count as often as they stand there.
    Only the id and the text are read, whatever other columns are called.
    """
    return group_variants(word_counts(docs, least, every, id_column, text_column).where(F.col("n") >= times), ratio)
