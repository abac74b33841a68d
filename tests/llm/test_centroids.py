import hashlib
import random

import numpy as np
import pytest

from conversion_engine.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def lloyd(points, k, rounds, seed=1):
    """Centroids and (cluster, distance) by id, with Python's integers and no bounds."""
    order = sorted(points, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centres = [list(points[i]) for i in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for v in points.values():
            members.setdefault(nearest(v)[1], []).append(v)
        for j, vs in members.items():
            centres[j] = [sum(col) // len(vs) for col in zip(*vs)]
    return centres, {i: nearest(v)[::-1] for i, v in points.items()}


def floats(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    hubs = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    return {i: [float(np.float32(h + rng.gauss(0, 0.1) * spread)) for h in hubs[i % 5]] for i in range(n)}


def whole(vectors, scale=64):
    return {i: [int(np.floor(scale * x)) for x in v] for i, v in vectors.items()}


@pytest.mark.parametrize("width, k, rounds", [(2, 3, 1), (8, 7, 5), (64, 16, 3)])
def test_equal_to_plain_rounds(spark, width, k, rounds):
    vectors = floats(300, width, width)
    vectors |= {300 + i: vectors[0] for i in range(100)}  # copies, and with them ties
    out = centroids.cluster_vectors(spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA).repartition(5),
                                    k, rounds, width).collect()
    centres, want = lloyd(whole(vectors), k, rounds)
    assert {r.vec_id: (r.cluster, r.distance) for r in out} == want
    total = sum(d for _, d in want.values())
    for r in out:
        assert r.inertia == total and r.cluster_inertia == sum(d for c, d in want.values() if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_unusable_vectors_extra_columns_and_limits(spark):
    from pyspark.sql import functions as F

    good = floats(6, 2, 1)
    rows = [(i, v, 0) for i, v in good.items()] + [
        (90, None, 0), (91, [1.0], 0), (92, [1.0, None], 0), (93, [float("nan"), 0.0], 0), (94, [float("inf"), 0.0], 0),
        (95, [3e38, -3e38], 0), (None, [0.5, 0.5], 0), (5, good[5], 0)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("_v", "_a", "cluster", "_id", "inertia")})
    out = centroids.cluster_vectors(table, 16, 2, 2).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in out) == [(False, i) for i in (0, 1, 2, 3, 4, 5, 5, 95)] + [(True, None)]
    assert all(r.distance == 0 for r in out if r.vec_id in (None, 95))  # fewer vectors than clusters: each is its own
    assert centroids.cluster_vectors(table.where("vec_id > 90 AND vec_id < 95"), 16, 2, 2).count() == 0
    assert centroids.cluster_vectors(table.limit(0)).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_sums_beyond_a_long_are_null(spark):
    big, n = [3e38 * (-1) ** j for j in range(64)], 40
    rows = [(0, big, 0), *[(i, [-x for x in big], 0) for i in range(1, n)], *[(n + i, [0.0] * 64, 0) for i in range(n)]]
    out = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA), 1, 0).collect()
    assert len(out) == 2 * n and {r.cluster_inertia for r in out} <= {None, sum(r.distance for r in out)}
    assert max(r.distance for r in out) <= 64 << 50


def test_bounds_hold_and_use_the_whole_displacement():
    rng = np.random.default_rng(2)
    v = rng.integers(-60, 60, (400, 8))
    history = rng.integers(-60, 60, (1, 6, 8))
    a, u, ut = np.full(400, -1, np.int32), np.zeros(400), np.zeros(400, np.int32)
    l, lt = np.zeros((400, 6)), np.zeros((400, 6), np.int32)
    assert centroids.reassign(v, a, u, ut, l, lt, history) == 400
    there, back = history[0] + 3, history[0]
    history = np.stack([history[0], there])
    centroids.reassign(v, a, u, ut, l, lt, history)
    kept = ut == 0  # not measured since the first round
    assert kept.any() and not kept.all()
    # Back where they were: bounds of the first round are as good as new, though the centroids have moved twice.
    history = np.concatenate([history, back[None]])
    assert centroids.displacements(history)[0].max() == 0
    centroids.reassign(v, a, u, ut, l, lt, history)
    exact = centroids.squared(v, back)
    assert (a == exact.argmin(1)).all()
    clear = np.sort(exact, 1)[:, 1] > exact.min(1)
    assert (ut[kept & clear] == 0).all()


def test_squared_distances_are_exact_for_large_numbers():
    v = np.array([[centroids.LIMIT, -centroids.LIMIT, 3]], np.int64)
    assert centroids.squared(v, -v)[0, 0] == 2 * (2 * centroids.LIMIT) ** 2 + 36
    assert (centroids.squared(v // 1024, v // 2048) >= 0).all()
