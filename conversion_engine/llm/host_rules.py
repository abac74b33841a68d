"""Quality rules per document, and verdicts per host from shrunk failure rates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conversion_engine.llm import common

_BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metrics(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the five counts of every whole text; NULL texts have no words.

    Repeated words are those in three-word windows found twice or more. The
    windows' hashes are sorted with their places, so the work is n log n in the
    text's length; texts whose windows all differ skip it.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    split = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_t"),
                        F.filter(F.split(text, common.SPACES), lambda w: w != "").alias("_w"))
    lines = split.select(*keep, "_t", "_w", F.size("_w").alias("_n"), F.filter(
        F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    hashed = lines.select(
        *keep, F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_t", _BLANK, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_n") >= 3, F.transform(
            F.sequence(F.lit(0), F.col("_n") - 3),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("_h"))
    ordered = hashed.withColumn("_s", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, j: F.coalesce(F.get("_s", j)["h"] == e["h"], F.lit(False))
    places = ordered.withColumn("_p", F.array_sort(F.transform(
        F.filter("_s", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3)))),
                          F.lit(0).cast("bigint"), lambda a, b: a + b)
    return places.select(*keep, *METRICS[:-1], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def rule_failed(max_symbol_percent: int = 10) -> Column:
    """What counts against a document's host: a base failure, or a text full of symbols."""
    return base_failed() | (100 * F.col("n_symbols") > max_symbol_percent * F.col("word_chars"))


def host_verdicts(judged: DataFrame, host: str, failed: str, max_rate: float = 0.5) -> DataFrame:
    """(host, n_documents, n_failed, shrunk_rate, rejected) for every host that is not NULL.

    The rates of all hosts fit a beta prior by its moments: mean m, and a strength
    M from the variance between hosts beyond that of sampling. A host's rate is
    (failures + m M) / (documents + M); small hosts stay near the mean.
    """
    hosts = judged.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count("*").alias("n_documents"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    n, k = F.col("n_documents"), F.col("n_failed")
    sums = hosts.agg(F.count("*").alias("h"), F.sum("n_documents").alias("n"), F.sum("n_failed").alias("k"),
                     F.sum(k * k / n).alias("q"))
    mean = F.col("k") / F.col("n")
    spread = mean * (1 - mean)
    # Variance between hosts, weighted by documents, less its share from sampling.
    extra = F.col("q") / F.col("n") - mean * mean - spread * F.col("h") / F.col("n")
    strength = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"),
                                              F.when(extra > 0, spread / extra - 1).otherwise(F.col("n"))))
    prior = sums.select(F.struct(mean.alias("m"), strength.alias("s")).alias("prior")).scalar()
    rate = (k + prior["m"] * prior["s"]) / (n + prior["s"])
    return hosts.select("host", "n_documents", "n_failed", rate.alias("shrunk_rate"),
                        (rate > max_rate).alias("rejected"))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
          max_rate: float = 0.5) -> DataFrame:
    """(``id_column``, the five counts, base_failed, host_rejected, kept), a row for each row of ``docs``.

    A document is kept if it passes the base rules and its host's shrunk failure
    rate is at most ``max_rate``. Texts are read once; the counts are stored and
    the rest works on them. Hosts are partial aggregates, so a hot host is no hot group.

    NULL and empty texts have no words and fail. A NULL host has no verdict: the
    document's own rules decide. Repeated rows count each. An empty table gives no row.
    """
    shelf = common.Shelf(docs.sparkSession, "host-rules")
    source = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{host_column}`").alias("_host"),
                         F.col(f"`{text_column}`").alias("_text"))
    found = metrics(source, "_text", ("_id", "_host"))
    stored = shelf.put(found.withColumns({"base_failed": base_failed(), "_failed": rule_failed()}), "metrics")
    verdicts = host_verdicts(stored, "_host", "_failed", max_rate).select(F.col("host").alias("_host"), "rejected")
    rejected = F.coalesce("rejected", F.lit(False))
    return stored.join(verdicts, "_host", "left").select(
        F.col("_id").alias(id_column), *METRICS, "base_failed", rejected.alias("host_rejected"),
        (~F.col("base_failed") & ~rejected).alias("kept"))
