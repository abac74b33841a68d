"""Column helpers with the warehouse semantics the analysis relies on.

Everything here is a built-in expression, so plans stay inside whole-stage
codegen.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- dates -----------------------------------------------------------------


def day_offset(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Calendar days from ``earlier`` to ``later``; midnight is the boundary."""
    return F.datediff(F.to_date(as_col(later)), F.to_date(as_col(earlier)))


def within_days(later: ColumnLike, earlier: ColumnLike, lo: int, hi: int) -> Column:
    return day_offset(later, earlier).between(lo, hi)


def iso_timestamp(text: ColumnLike) -> Column:
    """ISO text to a zone-free timestamp; unreadable text becomes NULL."""
    return as_col(text).try_cast("timestamp_ntz")


def weekend_flag(date: ColumnLike) -> Column:
    """1 on Saturday and Sunday, 0 otherwise (and for a missing date)."""
    return F.when(F.dayofweek(as_col(date)).isin(1, 7), 1).otherwise(0)


def least_strict(first: ColumnLike, *rest: ColumnLike) -> Column:
    """Smallest value, NULL as soon as one input is NULL."""
    columns = [as_col(first), *map(as_col, rest)]
    known = reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))
    return F.when(known, F.least(*columns))


# --- numbers ---------------------------------------------------------------


def div0(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Ratio that is 0 where the denominator is 0 (NULL inputs stay NULL)."""
    n, d = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    return F.when(n.isNotNull() & (d == 0), F.lit(0.0)).otherwise(F.try_divide(n, d))


def ratio_or_null(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Ratio that is NULL where the denominator is 0."""
    return F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


# --- text ------------------------------------------------------------------


def like_any(value: ColumnLike, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    value = as_col(value)
    tests = [value.ilike(p) if ignore_case else value.like(p) for p in patterns]
    return reduce(lambda a, b: a | b, tests)


# --- semi-structured text --------------------------------------------------


def json_value(parsed: ColumnLike, key: str, kind: str = "string") -> Column:
    """A typed value at a top-level key of a parsed variant; NULL when absent."""
    return F.try_variant_get(as_col(parsed), f"$.{key}", kind)


def json_fields(value: ColumnLike, keys: Iterable[str]) -> Column:
    """The named top-level keys of a JSON text, as a struct of texts; NULL when absent.

    Text in the JSON and numbers both come out as text, as a cast to text does.
    Unreadable JSON gives NULLs.
    """
    schema = ", ".join(f"`{key}` string" for key in dict.fromkeys(keys))
    return F.from_json(as_col(value), schema)


def typed_text(value: Column, kind: str) -> Column:
    """Text as a typed value; NULL where it does not read as one."""
    if kind == "string":
        return value
    if kind == "int":
        return value.try_cast("decimal(12,0)").try_cast("int")
    return value.try_cast(kind)


# --- day buckets -----------------------------------------------------------


@dataclass(frozen=True)
class Bucket:
    """An inclusive range of day offsets, e.g. days 2 to 5 after the install."""

    name: str
    lo: int
    hi: int

    def holds(self, offset: Column) -> Column:
        return offset.between(self.lo, self.hi)


# The reporting ranges of the 28-day analysis.
DAY_BUCKETS = (
    Bucket("day0", 0, 0),
    Bucket("day1", 1, 1),
    Bucket("days2to5", 2, 5),
    Bucket("days6to13", 6, 13),
    Bucket("days14to20", 14, 20),
    Bucket("days21to28", 21, 28),
)
FULL_WINDOW = Bucket("days0to28", 0, 28)
WINDOW_DAYS = 28


def day_buckets(offset: Column, value: ColumnLike, suffix: str,
                buckets: Iterable[Bucket] = (*DAY_BUCKETS, FULL_WINDOW)) -> list[Column]:
    """One aggregate per bucket: the sum of ``value`` over the bucket's days.

    Days without a value do not count, so the sums are NULL, not 0, for a key
    that has no value on any day.
    """
    value = as_col(value)
    return [
        F.sum(F.when(value.isNotNull(), F.when(b.holds(offset), value).otherwise(0))).alias(f"{b.name}_{suffix}")
        for b in buckets
    ]


def bucket_flags(offset: Column, condition: Column, suffix: str,
                 buckets: Iterable[Bucket]) -> list[Column]:
    """One 0/1 column per bucket, for row-level marking."""
    return [flag(condition & b.holds(offset)).alias(f"{b.name}_{suffix}") for b in buckets]
