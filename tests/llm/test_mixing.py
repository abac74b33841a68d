import random
import zlib

from helpers_llm import clashing, documents, table

from conversion_engine.llm import mixing


def test_period_is_earliest_deadline_first_and_pfair():
    pick = random.Random(1)
    for _ in range(200):
        weights = [pick.random() ** 3 + 1e-3 for _ in range(pick.randint(1, 12))]
        parts = mixing.shares(weights, 64)
        assert sum(parts) == 64 and min(parts) >= 1
        order = [None] * 64
        for s, slots in enumerate(mixing.period(parts)):
            assert len(slots) == parts[s]
            for k in slots:
                order[k] = s
        done = [0] * len(parts)
        for t, s in enumerate(order):
            done[s] += 1
            assert all(abs(done[j] - (t + 1) * parts[j] / 64) < 1 for j in range(len(parts)))


def simulate(blocks, weights, size):
    """Slot by slot: (source, slot) of all blocks, phases one after the other."""
    left, out, slot, done = dict(blocks), {}, 0, dict.fromkeys(blocks, 0)
    while any(left.values()):
        active = sorted(s for s in left if left[s] and weights.get(s)) or sorted(s for s in left if left[s])
        parts = mixing.shares([weights.get(s) or 1.0 for s in active], max(size, 4 * len(active)))
        total, taken, t = sum(parts), [0] * len(active), 0
        while all(left[s] for s in active):
            ready = [(-(-(taken[i] + 1) * total // parts[i]), i) for i in range(len(active)) if taken[i] * total // parts[i] <= t]
            _, i = min(ready)
            s = active[i]
            out[s, done[s]] = slot
            done[s] += 1
            left[s] -= 1
            taken[i] += 1
            t += 1
            slot += 1
    return out


def test_table_against_simulation(spark):
    pick = random.Random(2)
    rows = [(i, f"t{i}", None, pick.choice(["a"] * 6 + ["b", "b", "c", None]), i) for i in range(400)] + [(1, "t1", None, "c", 1)] * 3
    for weights in (None, {"a": 1.0, "b": 3.0, None: 0.5}):
        out = mixing.mix(clashing(table(spark, rows)), weights, block=3, slots_per_period=16)
        rank, slot, phase = out.columns[-3:]
        got = [r.asDict() for r in out.select("doc_id", "source", rank, slot, phase).collect()]
        assert len(got) == len(rows)
        key = lambda s: "" if s is None else f"={s}"
        counts = {}
        for r in rows:
            counts[key(r[3])] = counts.get(key(r[3]), 0) + 1
        named = {key(s): w for s, w in weights.items()} if weights else dict.fromkeys(counts, 1.0)
        want = simulate({s: -(-n // 3) for s, n in counts.items()}, named, 16)
        for s, n in counts.items():
            mine = sorted((r for r in got if key(r["source"]) == s), key=lambda r: r[rank])
            assert [r[rank] for r in mine] == list(range(n))
            assert [r[slot] for r in mine] == [want[s, r[rank] // 3] for r in mine]


def test_order_and_edges(spark):
    df = table(spark)
    mixed = mixing.mix(df)
    rank, slot, phase = mixed.columns[-3:]
    ordered = mixing.in_order(mixed, slot, rank)
    seen = [r[slot] for r in ordered.collect()]
    assert seen == sorted(seen) and len(seen) == len(documents())
    assert mixing.mix(table(spark, [])).count() == 0


def test_unequal_weights_hold_on_a_whole_table(spark):
    import pathlib

    import pytest

    from conversion_engine.llm.queries import op9_mix_sources

    root = "/root/testdata/sf0.01"
    if not pathlib.Path(root).exists():
        pytest.skip("test data is not here")
    counts = mixing.temperature_weights(spark.read.parquet(f"{root}/documents.parquet"))
    weights = {s: w * (1 + zlib.crc32((s or "").encode()) % 4) for s, w in counts.items()}
    assert max(weights.values()) > 1.5 * min(weights.values())
    rows = op9_mix_sources(spark, root).collect()
    blocks = {(r.phase, r.slot): r.source for r in rows}
    assert len({r.doc_id for r in rows}) == len(rows)
    for phase in {p for p, _ in blocks}:
        order = [s for (p, _), s in sorted(blocks.items()) if p == phase]
        key = lambda s: "" if s is None else f"={s}"
        active = sorted({s for (p, _), s in blocks.items() if p >= phase}, key=key)  # those that have blocks left
        parts = mixing.shares([weights[s] for s in active], max(1024, 4 * len(active)))
        done = dict.fromkeys(active, 0)
        for t, s in enumerate(order):
            done[s] += 1
            assert all(abs(done[a] - (t + 1) * q / sum(parts)) < 1 for a, q in zip(active, parts))
