"""Join helpers that stay balanced when one key holds much of the data.

No join in this package carries a broadcast hint. Spark broadcasts a side when
its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and joins
by shuffle beyond it, where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conversion_engine.functions.semantics import ColumnLike, as_col, within_days

_KEY = "__join_key"


def spread_key(key: ColumnLike, spread_by: Iterable[ColumnLike], usable: Column | None = None) -> Column:
    """``key`` as text where it can match, otherwise a value that matches nothing.

    Rows without a usable key would all hash to one shuffle partition. The
    stand-in differs from row to row and starts with a character that no real
    key starts with.
    """
    text = as_col(key).cast("string")
    usable = text.isNotNull() if usable is None else (usable & text.isNotNull())
    filler = F.concat(F.lit("\u0000"), F.xxhash64(*map(as_col, spread_by)).cast("string"))
    return F.when(usable, text).otherwise(filler)


def left_join_sparse(left: DataFrame, right: DataFrame, left_key: ColumnLike, right_key: str,
                     spread_by: Iterable[ColumnLike], usable: Column | None = None,
                     extra: Column | None = None) -> DataFrame:
    """Left join on a key that is often missing on the left.

    The right key column is dropped; ``extra`` is a further join condition.
    A missing right key matches nothing.
    """
    keyed_left = left.withColumn(_KEY, spread_key(left_key, spread_by, usable))
    # A stand-in instead of a filter: a filter on a computed key would be pushed
    # below the computation and repeat it.
    text = F.coalesce(F.col(right_key).cast("string"), F.lit("\u0001"))
    keyed_right = right.withColumn(f"{_KEY}_r", text).drop(right_key)
    condition = F.col(_KEY) == F.col(f"{_KEY}_r")
    if extra is not None:
        condition = condition & extra
    return keyed_left.join(keyed_right, condition, "left").drop(_KEY, f"{_KEY}_r")


def banded_join(cohort: DataFrame, log: DataFrame, key: str, cohort_date: str, log_date: str,
                lo: int = 0, hi: int = 28, how: str = "inner") -> DataFrame:
    """Rows of ``log`` between ``lo`` and ``hi`` days after the cohort date of the same key.

    ``key`` appears once in the result. Aggregate ``log`` to one row per key and
    day, and ``cohort`` to one row per key and cohort date, before calling this:
    both sides of one key are then bounded by the number of calendar days,
    however many raw rows the key has.
    """
    right = log.withColumnRenamed(key, f"{_KEY}_log")
    joined = cohort.join(
        right,
        (F.col(key) == F.col(f"{_KEY}_log")) & within_days(log_date, cohort_date, lo, hi),
        how,
    )
    return joined.drop(f"{_KEY}_log")


def in_calendar(df: DataFrame, date: str, calendar: DataFrame, calendar_date: str = "iddate") -> DataFrame:
    """Rows whose date the calendar has."""
    days = calendar.select(F.col(calendar_date).alias("__day"))
    return df.join(days, F.col(date) == F.col("__day"), "left_semi")


def lookup_ignoring_case(df: DataFrame, value: ColumnLike, dim: DataFrame, dim_value: str,
                         columns: dict[str, str]) -> DataFrame:
    """Left lookup by text regardless of letter case; ``columns`` maps dim to output names."""
    keys = dim.select(F.lower(F.col(dim_value)).alias("__lookup"),
                      *[F.col(c).alias(out) for c, out in columns.items()])
    return df.join(keys, F.lower(as_col(value)) == F.col("__lookup"), "left").drop("__lookup")


def month_bounds(calendar: DataFrame, date: str = "iddate", year: str = "idyear", month: str = "idmonth") -> DataFrame:
    """First and last calendar day of every day's month. A month has at most 31 rows."""
    whole_month = Window.partitionBy(year, month)
    return calendar.select("*", F.min(date).over(whole_month).alias("month_start_date"),
                           F.max(date).over(whole_month).alias("month_end_date"))
