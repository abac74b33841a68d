"""Labelled rows for the classifiers: the training fold, and a bounded sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str, folds: int = 5) -> Column:
    """Rows never learned from: those whose id, as text, has a CRC-32 divisible by ``folds``. Not so NULL ids."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % folds == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """(_id, _text, _label) of at most ``most`` labelled documents of the training fold, in the order of a hash.

    The ids are drawn first, from the labels alone; only their texts are read. Ids with two labels
    count with the larger, NULL labels not at all.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)) \
        .groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("double").alias("_label"))
    drawn = marked.orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col(f"`{id_column}`").alias("_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(drawn), "_id")  # at most ``most`` ids
