"""The booster against one that tries all splits, its model's tables, and attributions against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from conversion_engine.ml import explain, oblivious, training

FEATURES = ["a", "b", "c"]
SCHEMA = "id long, a double, b double, c double, label int, weight double, split string"


def table(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = float(rng.integers(0, 12)), float(np.round(rng.normal(), 2)), float(rng.integers(0, 3))
        p = 1 / (1 + math.exp(-(0.4 * (a - 6) * (1 if c else -1) + b)))
        label = int(rng.random() < p)
        rows.append((i, math.nan if i % 17 == 0 else a, b, c, label, 3.0 if label else 1.0, "validation" if i % 4 == 0 else "train"))
    return rows


def by_trying_all(rows, borders, trees, depth, rate=0.2, l2=3.0):
    """Splits and leaf values; every border of every feature is tried at every level, row by row."""
    x = [[-math.inf if math.isnan(v) else v for v in r[1:4]] for r in rows if r[6] == "train"]
    y, w = [r[4] for r in rows if r[6] == "train"], [r[5] for r in rows if r[6] == "train"]
    margin, out = [0.0] * len(x), []
    for _ in range(trees):
        p = [float(oblivious.sigmoid(np.array([m]))[0]) for m in margin]
        g = [round(wi * (yi - pi) * oblivious.UNIT) for wi, yi, pi in zip(w, y, p)]
        h = [round(wi * pi * (1 - pi) * oblivious.UNIT) for wi, pi in zip(w, p)]

        def score(cells):
            groups = {}
            for i, cell in enumerate(cells):
                total = groups.setdefault(cell, [0, 0])
                total[0] += g[i]
                total[1] += h[i]
            return groups, sum((s / oblivious.UNIT) ** 2 / (t / oblivious.UNIT + l2) for s, t in groups.values())
        cells, splits = [0] * len(x), []
        for level in range(depth):
            before = score(cells)[1]
            tried = []
            for f, cuts in enumerate(borders):
                for c, border in enumerate(cuts):
                    new = [cell + ((xi[f] > border) << level) for cell, xi in zip(cells, x)]
                    tried.append((score(new)[1] - before, -f, -c, new))
            best = max(tried, key=lambda t: t[:3])
            splits.append((-best[1], -best[2]))
            cells = best[3]
        groups, _ = score(cells)
        values = {cell: rate * (s / oblivious.UNIT) / (t / oblivious.UNIT + l2) for cell, (s, t) in groups.items()}
        margin = [m + values[cell] for m, cell in zip(margin, cells)]
        out.append((splits, values))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_are_those_of_trying_all_splits(spark, seed):
    rows = table(200, seed)
    booster = oblivious.Booster(spark.createDataFrame(rows, SCHEMA).repartition(5), FEATURES, depth=3, store_every=2)
    assert [len(c) for c in booster.borders][::2] == [11, 2]
    assert booster.grow(5) == 5
    booster.measure()
    for tree, (splits, values) in zip(booster.trees.trees, by_trying_all(rows, booster.borders, 5, 3)):
        assert [s[:2] for s in tree.splits] == splits
        for leaf, value in values.items():
            assert tree.values[leaf] == pytest.approx(value, abs=1e-12)
        assert tree.weights.sum() == pytest.approx(sum(r[5] for r in rows if r[6] == "train"))
    booster.close()


def same(a, b):
    return len(a.trees) == len(b.trees) and all(
        s.splits == t.splits and (s.values == t.values).all() and (s.weights == t.weights).all() for s, t in zip(a.trees, b.trees))


def test_rounds_partitions_and_order_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(table(400, 3), SCHEMA)
    whole, best, losses = oblivious.fit(df.coalesce(1), FEATURES, 40, depth=3, patience=4)
    assert len(whole.trees) == best + 4 == len(losses["validation"]) == len(losses["train"])
    monkeypatch.setattr(oblivious, "PARTITION_CELLS", 100)  # several partitions, with a shuffle of the sums
    booster = oblivious.Booster(df.repartition(7), FEATURES, depth=3, patience=4, store_every=3)
    assert booster.blocks.rdd.getNumPartitions() > 1
    while booster.grow(3) == 3:
        pass
    assert booster.stopped and booster.best() == best and booster.grow(5) == 0
    booster.measure()
    assert same(booster.trees, whole)
    assert booster.losses[oblivious.VALIDATION] == losses["validation"] and booster.losses[oblivious.TRAIN] == losses["train"]


@pytest.mark.parametrize("cells, most", [(1 << 24, 3), (400, None)])
def test_one_job_grows_many_trees(spark, monkeypatch, cells, most):
    """One task that has all rows grows all trees of a call in few jobs; the same trees as with a job a level, features counted jointly or not."""
    df = spark.createDataFrame(table(500, 6), SCHEMA)
    monkeypatch.setattr(oblivious, "PARTITION_CELLS", cells)
    booster = oblivious.Booster(df.repartition(3), FEATURES, depth=3, store_every=20)
    group = f"grow-{cells}"
    spark.sparkContext.setJobGroup(group, group)
    assert booster.grow(10) == 10
    spark.sparkContext.setJobGroup("", "")
    ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert ran <= most if most else ran >= 30
    booster.measure()
    monkeypatch.setattr(oblivious, "PARTITION_CELLS", 1 << 24)
    want, best, losses = oblivious.fit(df.coalesce(1), FEATURES, 10, depth=3, store_every=1)
    assert same(booster.trees, want) and booster.best() == best
    assert booster.losses[oblivious.TRAIN] == losses["train"] and booster.losses[oblivious.VALIDATION] == losses["validation"]
    booster.close()


def test_joint_counts_are_those_of_each_feature():
    rng, counts = np.random.default_rng(1), [2, 255, 1, 3, 7, 40, 20, 2]
    bins = np.stack([rng.integers(0, c, 900) for c in counts]).astype(np.uint8)
    assert sorted(f for g in oblivious.joint_groups(counts) for f in g) == [0, 1, 3, 4, 5, 6, 7]
    assert len(oblivious.joint_groups(counts)) < 6
    g, h = oblivious.fixed(rng.normal(size=900)), oblivious.fixed(rng.random(900))
    counter, leaf = oblivious._Counter(bins, counts), np.zeros(900, np.int64)
    counter.start(g, h)
    known = counter.first()
    for level, (feature, cut) in enumerate([(1, 100), (0, 0), (5, 11), (1, 3)]):
        for f, sums in known.items():
            want = oblivious._histogram(bins[f], counts[f], leaf, 1 << level, g, h).reshape(2, 1 << level, -1)
            assert (sums == want).all() and sums.dtype == np.int64
        below = known[feature][:, :, :cut + 1].sum(2)
        known = dict(counter.split(feature, cut, np.stack([below, known[feature].sum(2) - below], 1)))
        leaf |= (bins[feature] > cut).astype(np.int64) << level


def test_gradient_and_hessian_are_counted_at_once(monkeypatch):
    """One pass over the rows for both sums, exact for integers far above a float's 24 bits, over several pieces."""
    rng, passes = np.random.default_rng(2), []
    monkeypatch.setattr(oblivious, "PIECE_ROWS", 100)
    monkeypatch.setattr(oblivious, "_histogram", lambda *a: passes.append(a))
    bins = rng.integers(0, 200, (2, 950)).astype(np.uint8)
    g, h = rng.integers(-(1 << 40), 1 << 40, 950), rng.integers(0, 1 << 40, 950)
    counter = oblivious._Counter(bins, [200, 200])
    counter.start(g.astype(float), h.astype(float))
    for f, sums in counter.first().items():
        for cell in range(200):
            assert list(sums[:, 0, cell]) == [int(g[bins[f] == cell].sum()), int(h[bins[f] == cell].sum())]
    assert not passes


def test_shares_of_all_borders_are_one_column(spark, monkeypatch):
    given, real = [], F.percentile_approx
    monkeypatch.setattr(oblivious.F, "percentile_approx", lambda c, shares, accuracy: given.append(shares) or real(c, shares, accuracy))
    df = spark.createDataFrame([(float(i), float(i % 5)) for i in range(100)], "a double, b double")
    borders = oblivious.feature_borders(df, ["a", "b"], 4)
    assert [list(b) for b in borders] == [[24.0, 49.0, 74.0], [1.0, 2.0, 3.0]]
    assert len(given) == 2 and given[0] is given[1] and isinstance(given[0], Column)


def test_twenty_trees_are_kept_where_there_is_a_signal(spark):
    rows = table(3000, 4)
    trees, best, losses = oblivious.fit(spark.createDataFrame(rows, SCHEMA), FEATURES, 200, depth=3, learning_rate=0.1, patience=10)
    assert best >= 20 and len(trees.trees) == best + 10
    assert losses["validation"][best - 1] == min(losses["validation"]) < 0.8 * losses["validation"][0]


def test_nothing_to_split(spark):
    rows = [(i, 1.0, 2.0, 3.0, i % 2, 1.0, "train") for i in range(10)]
    trees, best, losses = oblivious.fit(spark.createDataFrame(rows, SCHEMA), FEATURES, 5)
    assert trees.trees == [] and best == 0 and losses == {"train": []}
    assert spark.createDataFrame(rows, SCHEMA).select(trees.score_column().alias("s")).distinct().collect() == [(0.5,)]
    with pytest.raises(ValueError):
        oblivious.Booster(spark.createDataFrame(rows, SCHEMA), FEATURES, max_bins=300)


@pytest.fixture(scope="module")
def model(spark):
    rows = table(300, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    trees, _, losses = oblivious.fit(df, FEATURES, 6, depth=3)
    return rows, df, trees, losses


def test_curve_of_rows_is_that_of_training(model):
    _, df, trees, losses = model
    got = {(r.split, r.iteration): r.logloss for r in training.learning_curve(trees, df).collect()}
    assert got == {(s, i): pytest.approx(v, abs=1e-9) for s, values in losses.items() for i, v in enumerate(values)}


def test_tables_hold_the_whole_model(spark, model):
    _, df, trees, _ = model
    again = oblivious.Trees.from_tables(FEATURES, trees.nodes(spark), trees.leaves(spark))
    a, b = (df.select("id", t.score_column().alias("s")) for t in (trees, again))
    assert sorted(a.collect()) == sorted(b.collect())
    assert trees.nodes(spark).count() == 18 and trees.leaves(spark).count() == 48


def path_value(tree, x, known, leaf=0, level=0):
    """The value of a tree for a row of which ``known`` features are used, node by node."""
    if level == len(tree.splits):
        return tree.values[leaf]
    feature, _, border, _ = tree.splits[level]
    below, above = leaf, leaf | 1 << level
    if feature in known:
        return path_value(tree, x, known, above if x[feature] > border else below, level + 1)
    weigh = lambda at: sum(w for i, w in enumerate(tree.weights) if i % (2 << level) == at)
    low, high = weigh(below), weigh(above)
    share = low / (low + high) if low + high else 0.5
    return share * path_value(tree, x, known, below, level + 1) + (1 - share) * path_value(tree, x, known, above, level + 1)


def test_attributions_are_those_of_all_subsets(model):
    rows, df, trees, _ = model
    got = {r.id: (r.base, r["values"]) for r in explain.attributions(trees, df, "id").collect()}
    margins = {r.id: math.log(r.s / (1 - r.s)) for r in df.select("id", trees.score_column().alias("s")).collect()}
    for r in rows[:40]:
        x = [-math.inf if math.isnan(v) else v for v in r[1:4]]
        worth = {s: sum(path_value(t, x, s) for t in trees.trees)
                 for n in range(4) for s in map(frozenset, itertools.combinations(range(3), n))}
        want = [sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (worth[s | {f}] - worth[s]) for s in worth if f not in s)
                for f in range(3)]
        assert got[r[0]][1] == pytest.approx(want, abs=1e-12) and got[r[0]][0] == pytest.approx(worth[frozenset()], abs=1e-12)
    for i, (base, values) in got.items():
        assert base + sum(values) == pytest.approx(margins[i], abs=1e-9)


def test_importance_is_the_change_of_sibling_leaves(model):
    _, df, trees, _ = model
    want = dict.fromkeys(FEATURES, 0.0)
    for t in trees.trees:
        for level, split in enumerate(t.splits):
            for leaf in range(len(t.values)):
                other = leaf | 1 << level
                if leaf != other and t.weights[leaf] + t.weights[other]:
                    both = t.weights[leaf] + t.weights[other]
                    mean = (t.values[leaf] * t.weights[leaf] + t.values[other] * t.weights[other]) / both
                    want[FEATURES[split[0]]] += t.weights[leaf] * (t.values[leaf] - mean) ** 2 + t.weights[other] * (t.values[other] - mean) ** 2
    again = {(r.tree, r.leaf): (r.value, r.weight) for r in training.leaf_weights(trees, df.where("split = 'train'")).collect()}
    assert again == {(i, leaf): pytest.approx((t.values[leaf], t.weights[leaf])) for i, t in enumerate(trees.trees) for leaf in range(len(t.values))}
    got = training.importance(trees, ["x", "y", "z"]).collect()
    assert {r.feature: r.importance for r in got} == {n: pytest.approx(100 * want[f] / sum(want.values())) for n, f in zip("xyz", FEATURES)}
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)


def test_ordered_rates_see_earlier_rows_of_other_groups_only(spark):
    import hashlib
    import random

    rng = random.Random(2)
    rows = [(i, f"g{rng.randrange(150)}", int(rng.random() < 0.4), rng.choice(["hot", "hot", "hot", "b", None]), rng.choice("xyz")) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, grp string, label int, c string, d string").repartition(4)
    mark = {r[1]: hashlib.md5(f"64:{r[1]}".encode()).hexdigest() for r in rows}
    for digits in (1, 3):
        got = {r.id: (r["c__rate"], r["d__rate"]) for r in training.ordered_rates(
            df, ["c", "d"], "label", "id", 0.3, 2.0, group="grp", digits=digits).collect()}
        for i, grp, _, *values in rows:
            for at, v in enumerate(values):
                seen = [r[2] for r in rows if r[3 + at] == v and mark[r[1]] < mark[grp]]
                want = 0.3 if v is None else (sum(seen) + 0.6) / (len(seen) + 2.0)
                assert got[i][at] == pytest.approx(want)
    alone = training.ordered_rates(df, ["c"], "label", "id", 0.3)
    first = sorted((hashlib.md5(f"64:{r[0]}".encode()).hexdigest(), r[0]) for r in rows if r[3] == "hot")[0][1]
    assert alone.where(F.col("id") == first).first()["c__rate"] == pytest.approx(0.3)
