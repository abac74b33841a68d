"""Interleaving sources to target weights: Pfair blocks in earliest-deadline-first order."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conversion_engine.llm import common


def period(shares: list[int]) -> list[list[int]]:
    """Slots of every source's blocks in one period of sum(shares) slots.

    Block k of a source with share q of Q slots is released at floor(k Q / q) and due by
    ceil((k + 1) Q / q). At each slot the released block with the earliest deadline goes, of equal
    ones that of the first source. The shares fill the period, so every block meets its
    deadline and no source is ever a whole block ahead or behind its weight.
    """
    total = sum(shares)
    waiting = [(0, s, 0) for s, q in enumerate(shares) if q]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: list[list[int]] = [[] for _ in shares]
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // shares[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        if k + 1 < shares[s]:
            heapq.heappush(waiting, ((k + 1) * total // shares[s], s, k + 1))
    return slots


def shares(weights: list[float], total: int) -> list[int]:
    """Whole shares of ``total``, at least one each, nearest to the weights (largest remainders)."""
    scale = (total - len(weights)) / sum(weights)
    exact = [w * scale for w in weights]
    out = [1 + int(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (int(exact[i]) - exact[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


@dataclass
class Phase:
    """While the same sources last: the first block and slot, and the period's slots of each source."""

    slot: int
    length: int
    first: dict[str, int]
    slots: dict[str, list[int]]


def phases(blocks: dict[str, int], weights: dict[str, float], slots_per_period: int) -> list[Phase]:
    """The schedule of all blocks. A phase ends with the last block of one of its sources; those
    left go on with their weights scaled up. Sources without weight come last, in equal parts."""
    out, done, slot = [], dict.fromkeys(blocks, 0), 0
    while True:
        left = sorted(s for s in blocks if done[s] < blocks[s])
        if not left:
            return out
        active = [s for s in left if weights.get(s, 0) > 0] or left
        parts = shares([weights.get(s, 0) or 1.0 for s in active], max(slots_per_period, 4 * len(active)))
        length = sum(parts)
        places = dict(zip(active, period(parts)))
        out.append(Phase(slot, length, {s: done[s] for s in active}, places))

        def last(s: str) -> int:
            turn, k = divmod(blocks[s] - done[s] - 1, len(places[s]))
            return turn * length + places[s][k]

        turn, end = divmod(min(map(last, active)) + 1, length)
        for s in active:
            done[s] += turn * len(places[s]) + bisect_left(places[s], end)
        slot += turn * length + end


def _key(column: Column) -> Column:
    """Sources as text; NULL is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def ranked(docs: DataFrame, source: Column, bits: int = 12) -> DataFrame:
    """``docs`` with _src and _rank: the place among its source's rows, in the order of a hash of the row.

    Rows are numbered within ranges of the hash, ``2 ** bits`` a source, and ranges by
    running sums over their counts: a source with a third of all rows is no group of its own.
    """
    kinds = [f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    hashes = common.row_key(*kinds)
    keyed = docs.withColumns({"_src": _key(source), "_o1": hashes[0], "_o2": hashes[1]})
    keyed = keyed.withColumn("_range", F.shiftright(F.col("_o1"), 64 - bits))
    counts = keyed.groupBy("_src", "_range").agg(F.count("*").alias("_c"))
    up = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_src", "_range", F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_src", "_range").orderBy("_o1", "_o2")) - 1
    return keyed.withColumn("_within", within).join(starts, ["_src", "_range"]) \
        .withColumn("_rank", F.col("_start") + F.col("_within")).drop("_start", "_within", "_range", "_o1", "_o2")


def temperature_weights(docs: DataFrame, exponent: float = 0.5, source_column: str = "source",
                        max_sources: int = 4096) -> dict[str | None, float]:
    """Target weights by source: its number of rows to the power ``exponent`` (1: as they are, 0: all alike).

    One number per source reaches the driver, as for ``mix``, which refuses more than ``max_sources``.
    """
    found = docs.groupBy(F.col(f"`{source_column}`").cast("string").alias("s")).agg(F.count("*").alias("n")).limit(max_sources + 1).collect()
    return {r["s"]: float(r["n"]) ** exponent for r in found}


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, source_column: str = "source",
        block: int = 8, slots_per_period: int = 1024, max_sources: int = 4096) -> DataFrame:
    """``docs`` with rank (in its source), slot and phase, the last three columns: the order of the mixture.

    A source's rows, in the order of a hash, form blocks of ``block`` rows; each
    block has one slot. Within a phase, after any number of slots every source has had its
    share of them to less than one block. A phase lasts until a source is used up; the
    others then share its part. No row is dropped or repeated. ``weights`` are
    target weights by source, rounded to whole slots of a period; None weighs all
    sources alike, and sources without one follow at the end.

    The schedule of one period is a table of ``slots_per_period`` slots a phase, sent to the
    executors; blocks find their slot by arithmetic. The driver sees a row count for each
    source and refuses more than ``max_sources``, a limit on the configuration.

    A NULL source is a source. Rows equal in all columns are ranked one after the other. NULLs elsewhere
    don't matter. An added column that the input has already gets underscores in front. An empty table
    gives no row.
    """
    spark = docs.sparkSession
    own = [common.fresh(docs, n) for n in ("rank", "slot", "phase")]
    docs, names = common.numbered(docs)
    source = F.col(names[source_column])
    found = docs.groupBy(_key(source).alias("s")).agg(F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    counts = {r["s"]: r["n"] for r in found}
    wanted = {("" if s is None else f"={s}"): w for s, w in weights.items()} if weights is not None \
        else dict.fromkeys(counts, 1.0)
    plan = phases({s: -(-n // block) for s, n in counts.items()}, wanted, slots_per_period)
    table = [(s, [i for i, p in enumerate(plan) if s in p.first],
              [p.first[s] for p in plan if s in p.first], [p.slot for p in plan if s in p.first],
              [p.length for p in plan if s in p.first], [p.slots[s] for p in plan if s in p.first]) for s in counts]
    schedule = spark.createDataFrame(table, "_src string, _phases array<int>, _firsts array<long>, _slots array<long>, "
                                            "_lengths array<long>, _places array<array<int>>")
    rows = ranked(docs, source).join(F.broadcast(schedule), "_src")  # a row per source, at most max_sources
    number = F.floor(F.col("_rank") / block)
    at = F.size(F.filter("_firsts", lambda f: f <= F.col("_number"))) - 1
    offset = F.col("_number") - F.get("_firsts", F.col("_at"))
    places = F.get("_places", F.col("_at"))
    slot = F.get("_slots", F.col("_at")) + F.floor(offset / F.size(places)) * F.get("_lengths", F.col("_at")) \
        + F.get(places, (offset % F.size(places)).cast("int"))
    return rows.withColumn("_number", number.cast("long")).withColumn("_at", at).select(
        *[F.col(new).alias(old) for old, new in names.items()], F.col("_rank").cast("long").alias(own[0]), slot.cast("long").alias(own[1]),
        F.get("_phases", F.col("_at")).alias(own[2]))


def in_order(mixed: DataFrame, *order: str) -> DataFrame:
    """Rows sorted across and within partitions, for a reader that goes file by file."""
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
