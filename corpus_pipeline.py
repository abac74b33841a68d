"""A training corpus from raw documents: filter, remove repeats, mix sources, pack.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, folder of the tables) and
returns a DataFrame, which is written and read again as the next one's documents. All but the last return
the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conversion_engine.llm import common, line_dedup, mixing, ngram_join, packing, quality_crf
from conversion_engine.llm.queries import tokenizer

#: The field's training is iterative and packing is a dynamic program: SQL cannot express them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below 0.3 go; it learns from the labels of the training fold."""
    return quality_crf.keep_good(docs, quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents left without a word; n_chars follows the text."""
    text = F.col("text")
    cut = line_dedup.dedup_lines(docs).select(docs.columns).where(text.rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 over five-word shingles, the document of the smallest id stays."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, files in the order of a mixture in which all sources weigh alike."""
    mixed = mixing.mix(docs)
    rank, slot, _ = mixed.columns[-3:]
    return mixing.in_order(mixed, slot, rank).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 tokens, in the order of the mixture.

    A scan puts files together by size, so the order is not that of the stage before: the mixture, a
    function of the rows alone, is made again and its ranges are packed one after the other.
    """
    return packing.pack(mixture(spark, docs, sf_dir), **tokenizer())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of ``documents``; every stage's result is a table on the shared folder."""
    shelf = common.Shelf(spark, "pipeline")
    docs, last = common.documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
        if last:
            shelf.drop(last)
        last = name
    return docs
