import numpy as np
from helpers_llm import as_dict

from conversion_engine.llm import caps

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(seed=0, n=300):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(12, 32))
    out = []
    for i in range(n):
        v = centres[i % 12] + random.normal(size=32) * random.choice([0.02, 0.3, 1.0])
        out.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    out += [(1000 + i, out[0][1], 0) for i in range(5)] + [(1010, [2 * x for x in out[0][1]], 0), (1011, out[0][1], None)]
    nan, inf = float("nan"), float("inf")
    out += [(1020, None, 0), (1021, [0.0] * 32, 0), (1022, [nan] + [1.0] * 31, 0), (1023, [inf] + [1.0] * 31, 0),
            (1024, [None] + [1.0] * 31, 0), (1025, [], 0), (1026, [1.0, 2.0], 0), (1027, [1.0, 2.0], 0)]
    return out


def brute_force(data, least=0.93):
    good = [(i, np.array(v, float), label) for i, v, label in data
            if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = [(i, v / np.linalg.norm(v), label) for i, v, label in good]
    links, group = dict.fromkeys((i for i, *_ in data), 0), {i: i for i, *_ in data}
    for k, (a, u, x) in enumerate(unit):
        for b, v, y in unit[:k]:
            if x == y and len(u) == len(v) and u @ v >= least:
                links[a] += 1
                links[b] += 1
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i: (links[i], group[i], group[i] == i) for i in links}


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want = brute_force(data)
    got = as_dict(caps.near_vectors(df), "vec_id")
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values()) > 0
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)
    small_blocks = as_dict(caps.near_vectors(df, block=8), "vec_id")
    assert small_blocks == got


def test_recall_at_the_threshold():
    random = np.random.default_rng(5)
    a = random.normal(size=(1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = random.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(len(a), bool)
    for seed in range(4):
        x, y = caps.decode(a, seed, 16, 8), caps.decode(b, seed, 16, 8)
        met |= (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.97


def test_decoding_gives_the_nearest_directions():
    unit = np.random.default_rng(2).normal(size=(20, 10))
    rotation, vectors = caps.code(0, 10, 4)
    turned, size = unit @ rotation.T, vectors.shape[2]
    parts = [turned[:, p * size:(p + 1) * size] @ vectors[p].T for p in range(4)]
    total = (parts[0][:, :, None, None, None] + parts[1][:, None, :, None, None] + parts[2][:, None, None, :, None]
             + parts[3][:, None, None, None, :]).reshape(20, -1)
    best = np.argsort(-total, axis=1)[:, :8]
    assert (np.sort(best, axis=1) == np.sort(caps.decode(unit, 0, 4, 8), axis=1)).all()


def test_empty_and_repeated(spark):
    assert caps.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0)] * 2 + [(None, [1.0, 0.0], 0), (None, None, 0)], SCHEMA)
    got = sorted(map(tuple, caps.near_vectors(twice).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True), (None, 2, 1, False)]
