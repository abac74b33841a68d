"""Lines that repeat across documents, exactly or but for one word. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conversion_engine.llm import common

_REF = ["_k1", "_k2", "_line"]
_ORDER = ["_id", *_REF]


def words(line: Column) -> Column:
    """The words of a line, which is in lower case already; lines with equal words are equal lines."""
    inner = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, common.SPACES))


def _half_keys(w: Column, n: Column, min_words: int) -> Column:
    """Hashes of the first and of the last k words, k the largest power of two with 2k + 1 <= n.

    One edited word leaves the first or the last k words of both lines alike. A line
    of 2k + 1 words also has the keys of k / 2, those of lines a word shorter.
    """
    k = F.pow(F.lit(2.0), F.floor(F.log2((n - 1) / 2))).cast("int")
    both = lambda k: (F.xxhash64(F.lit(0), k, F.slice(w, 1, k)),
                      F.xxhash64(F.lit(1), k, F.slice(w, n - k + 1, k)))
    lower = (n == 2 * k + 1) & (n > min_words)
    half = F.when(lower, (k / 2).cast("int")).otherwise(F.lit(1))
    keys = F.array(*both(k), *[F.when(lower, x) for x in both(half)])
    return F.when(n >= min_words, F.array_compact(keys))


def _split_once(df: DataFrame, text: Column, where: Column) -> DataFrame:
    """``df`` with the lines of ``text`` as ``_parts``, where asked for. A generator, since a plain column would be moved into
    the functions that pick single lines, and split again for each."""
    return df.select("*", F.inline(F.array(F.struct(F.when(where, F.split(text, "\n")).alias("_parts")))))


def _lines(source: DataFrame) -> DataFrame:
    return source.select("_id", "_k1", "_k2", F.posexplode(F.split(F.lower("_text"), "\n")).alias("_line", "_value"))


def first_lines(source: DataFrame, min_words: int) -> DataFrame:
    """The first occurrence of every distinct line, and every blank line: its place and its half keys."""
    split = _lines(source).withColumn("_w", words(F.col("_value")))
    sized = split.withColumn("_n", F.size("_w"))
    blank = F.col("_n") == 0
    hashed = sized.select(
        # Blank lines are layout: each is its own.
        F.when(blank, F.xxhash64(*_REF)).otherwise(F.xxhash64("_w")).alias("_h1"),
        F.when(blank, F.xxhash64(*reversed(_REF))).otherwise(F.xxhash64(F.lit(7), "_w")).alias("_h2"),
        F.struct(*_ORDER, "_n", _half_keys(F.col("_w"), F.col("_n"), min_words).alias("_keys")).alias("_first"))
    return hashed.groupBy("_h1", "_h2").agg(F.min("_first").alias("_first")).select("_first.*")


def _variants(lines: DataFrame) -> DataFrame:
    """(order, _n, _i, _v, _whole): a row for every word of a line, with the hash of the line without it.

    A line's hash is the exclusive or of its words' hashes, each salted with its place. Without
    word i, words before it keep their place and those after it move up by one, so the variant's
    hash is a running value of the first kind and the rest of the second.
    """
    rows = lines.select(*_ORDER, "_n", F.posexplode("_words").alias("_i", "_word")).select(
        *_ORDER, "_n", "_i", F.xxhash64("_i", "_word").alias("_stay"), F.xxhash64(F.col("_i") - 1, "_word").alias("_move"))
    line = Window.partitionBy(*_REF)
    upto = line.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    stay, move = F.bit_xor("_stay"), F.bit_xor("_move")
    before = stay.over(upto).bitwiseXOR(F.col("_stay"))
    after = move.over(line).bitwiseXOR(move.over(upto))
    return rows.select(*_ORDER, "_n", "_i", before.bitwiseXOR(after).alias("_v"), stay.over(line).alias("_whole"))


def _within_one(a: Column, b: Column) -> Column:
    """Is the edit distance of two word lists at most one?"""
    def shared(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(at == 0, F.greatest(F.size(x), F.size(y))).otherwise(at - 1)
    return shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def near_duplicates(firsts: DataFrame, source: DataFrame, shelf: common.Shelf) -> DataFrame:
    """Places of lines that lie one word from an earlier one.

    Lines without a partner for either half drop out first. The rest emit all variants
    without one word; equal variants meet by hash, and the earliest of a group removes the
    others. A group's result is a minimum, so templates shared by any number of lines make
    no pairs. Each removed line and its earliest partner are then compared word by word.
    """
    halves = firsts.select(*_REF, F.explode("_keys").alias("_key"))
    shared = halves.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1").select("_key")
    wanted = halves.join(shared, "_key", "left_semi").groupBy("_k1", "_k2").agg(
        F.collect_set("_line").alias("_wanted"))
    # A hash of the keys and places of a partition's documents; their texts need no sorting.
    texts = _split_once(source.join(wanted.hint("shuffle_hash"), ["_k1", "_k2"]), F.lower("_text"), F.lit(True))
    picked = F.transform("_wanted", lambda i: F.struct(i.alias("_line"), F.get("_parts", i).alias("_value")))
    each = texts.select("_id", "_k1", "_k2", F.inline(picked)).dropDuplicates(_REF)  # equal rows
    lines = shelf.put(each.select(*_ORDER, words(F.col("_value")).alias("_words")).withColumn("_n", F.size("_words")), "lines")

    variants = _variants(lines)
    entries = shelf.put(variants.select(
        *_ORDER, F.explode(F.when(F.col("_i") == 0, F.array(
            F.struct(F.col("_v").alias("_h"), (F.col("_n") - 1).alias("_len"), F.col("_i").alias("_at")),
            F.struct(F.col("_whole").alias("_h"), F.col("_n").alias("_len"), F.lit(-1).alias("_at"))))
            .otherwise(F.array(F.struct(F.col("_v").alias("_h"), (F.col("_n") - 1).alias("_len"),
                                        F.col("_i").alias("_at"))))).alias("_e")).select(*_ORDER, "_e.*"), "entries")
    meeting = entries.groupBy("_h", "_len").agg(F.count("*").alias("_c")).where("_c > 1").select("_h", "_len")
    met = shelf.put(entries.join(meeting, ["_h", "_len"], "left_semi").select(
        "_h", "_len", "_at", F.struct(*_ORDER).alias("_o")), "met")

    whole = F.col("_at") < 0
    earliest = F.min("_o").alias("_p")
    replaced = met.where(~whole).join(met.where(~whole).groupBy("_h", "_len", "_at").agg(earliest), ["_h", "_len", "_at"])
    longer = met.where(~whole).join(met.where(whole).groupBy("_h", "_len").agg(earliest), ["_h", "_len"])
    shorter = met.where(whole).join(met.where(~whole).groupBy("_h", "_len").agg(earliest), ["_h", "_len"])
    pairs = replaced.select("_o", "_p").union(longer.select("_o", "_p")).union(shorter.select("_o", "_p"))
    found = pairs.where("_p < _o").groupBy("_o").agg(earliest)
    mine = lines.select(*[F.col(c) for c in _REF], F.col("_words").alias("_mine"))
    other = lines.select(*[F.col(c).alias(f"_p{c}") for c in _REF], F.col("_words").alias("_other"))
    places = found.select(*[F.col(f"_o.{c}").alias(c) for c in _REF], *[F.col(f"_p.{c}").alias(f"_p{c}") for c in _REF])
    checked = places.join(mine, _REF).join(other, [f"_p{c}" for c in _REF])
    return checked.where(_within_one(F.col("_mine"), F.col("_other"))).select(*_REF)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = 9) -> DataFrame:
    """``docs`` with repeated lines taken out of its texts, and n_lines, n_exact, n_near (lines, and lines removed).

    A line (between line feeds) goes if an earlier line has the same words, letter case aside, or,
    where both have at least ``min_words`` words, differs from it by one word inserted, deleted or
    replaced. Earlier means a smaller id, then the place in the text; the earlier line counts
    whether or not it stays itself. Blank lines stay.

    NULL texts stay NULL, with no lines; an empty text is one blank line. NULL ids come first.
    Rows equal in id and text are one document, kept as often as they occur; rows with one id and
    different texts are ordered by a hash. Other columns pass through; if the input has columns
    with a counter's name, the counter gets underscores in front. An empty table gives no row.
    """
    shelf = common.Shelf(docs.sparkSession, "line-dedup")
    k1, k2 = common.row_key(id_column, text_column)
    text = F.col(f"`{text_column}`")
    source = docs.select(F.col(f"`{id_column}`").alias("_id"), text.alias("_text"), k1.alias("_k1"), k2.alias("_k2")) \
        .where("_text IS NOT NULL")
    firsts = shelf.put(first_lines(source, min_words), "firsts")
    near = near_duplicates(firsts, source, shelf).withColumn("_near", F.lit(True))
    kept = shelf.put(firsts.select(*_REF).join(near, _REF, "left").groupBy("_k1", "_k2").agg(
        F.array_sort(F.collect_list(F.when(F.col("_near").isNull(), F.col("_line")))).alias("_kept"),
        F.count("*").alias("_first"), F.count("_near").alias("_close")), "kept")
    shelf.keep("kept")
    names = [common.fresh(docs, n) for n in ("n_lines", "n_exact", "n_near")]
    rows, columns = common.numbered(docs)
    k1, k2 = common.row_key(columns[id_column], columns[text_column])
    text = F.col(columns[text_column])
    joined = rows.withColumns({"_k1": k1, "_k2": k2}).join(kept.hint("shuffle_hash"), ["_k1", "_k2"], "left")
    size = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    close = F.coalesce("_close", F.lit(0)).cast("long")
    # Indexes of the kept lines instead of a search for each line: linear in the text. Only texts that lose a line are rebuilt.
    left = F.coalesce("_kept", F.array().cast("array<int>"))
    same = F.size(left) == size
    new = F.when(same, text).otherwise(F.array_join(F.transform(left, lambda i: F.get("_parts", i)), "\n"))
    return _split_once(joined, text, ~same).select(
        *[(F.when(text.isNotNull(), new) if old == text_column else F.col(c)).alias(old) for old, c in columns.items()],
        F.when(text.isNull(), F.lit(0)).otherwise(size).cast("long").alias(names[0]),
        F.when(text.isNull(), F.lit(0)).otherwise(size - F.coalesce("_first", F.lit(0))).cast("long").alias(names[1]),
        close.alias(names[2]))
