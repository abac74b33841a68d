import random

import pytest
from pyspark.sql import functions as F

from conversion_engine.ml import evaluate, explain, oblivious, training
from conversion_engine.operators import features


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def roc_by_hand(rows):
    pos = sum(l for l, _ in rows)
    neg = len(rows) - pos
    groups = sorted({s for _, s in rows}, reverse=True)
    counts = [(sum(l for l, s in rows if s == g), sum(1 - l for l, s in rows if s == g)) for g in groups]
    tp = fp = 0
    points = [(float("inf"), 0.0, 0.0)]
    for i, (p, n) in enumerate(counts):
        tp, fp = tp + p, fp + n
        if i in (0, len(counts) - 1) or counts[i + 1] != (p, n):
            points.append((groups[i], fp / neg, tp / pos))
    return sorted(points)


def auc_by_hand(rows):
    pos, neg = [s for l, s in rows if l], [s for l, s in rows if not l]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("slices", [1, 3, 8])
def test_roc_and_auc_with_ties_in_any_number_of_slices(spark, slices):
    rng = random.Random(3)
    # A third of the rows share one score.
    rows = [(rng.randint(0, 1), 0.5 if rng.random() < 0.34 else rng.randint(0, 60) / 60) for _ in range(300)]
    df = scored(spark, rows)
    got = sorted(tuple(r) for r in evaluate.roc_points(df, slices=slices).collect())
    assert [tuple(round(v, 9) for v in p) for p in got] == [tuple(round(v, 9) for v in p) for p in roc_by_hand(rows)]
    assert abs(evaluate.roc_auc(df, slices=slices).first()[0] - auc_by_hand(rows)) < 1e-9
    full = sorted((r.fpr, r.tpr) for r in evaluate.roc_points(df, drop_intermediate=False, slices=slices).collect())
    area = sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(full, full[1:]))
    assert abs(area - auc_by_hand(rows)) < 1e-9
    assert all(a[1] <= b[1] for a, b in zip(full, full[1:]))


def test_score_equal_to_the_threshold_is_negative(spark):
    df = scored(spark, [(1, 0.5), (1, 0.51), (0, 0.49)])
    assert [r.prediction for r in evaluate.threshold_predictions(df).collect()] == [0, 1, 0]
    assert [r.prediction for r in evaluate.threshold_predictions(df, threshold=0.2).collect()] == [1, 1, 1]


def test_metrics_and_empty_predicted_class(spark):
    r = evaluate.binary_metrics(scored(spark, [(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.1)])).first()
    assert tuple(r) == (0.5, 0.5, 0.5, 0.5, 0.75)
    r = evaluate.binary_metrics(scored(spark, [(1, 0.1), (0, 0.2)])).first()
    assert (r.precision, r.recall, r.f1_score) == (0.0, 0.0, 0.0)


def test_single_class(spark):
    df = scored(spark, [(1, 0.9), (1, 0.2)])
    assert evaluate.roc_auc(df).first()[0] is None
    r = evaluate.binary_metrics(df).first()
    assert (r.accuracy, r.precision, r.recall, r.roc_auc) == (0.5, 1.0, 0.5, None)


def test_confusion_and_report(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(1, 1)] * 2
    df = spark.createDataFrame(rows, "label int, prediction int")
    cells = {(r.label, r.prediction): r for r in evaluate.confusion(df).collect()}
    assert {k: r.rows for k, r in cells.items()} == {(0, 0): 5, (0, 1): 1, (1, 0): 2, (1, 1): 2}
    assert sum(r.rows for r in cells.values()) == len(rows) and abs(sum(r.share_of_all for r in cells.values()) - 1) < 1e-12
    assert abs(cells[0, 0].share_of_class - 5 / 6) < 1e-12
    report = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert report["0"].support == 6 and abs(report["0"].precision - 5 / 7) < 1e-12
    assert abs(report["1"].f1_score - 4 / 7) < 1e-12 and report["accuracy"].f1_score == 0.7
    assert abs(report["weighted avg"].recall - 0.7) < 1e-12


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    got = {r.label: (r.rows, r.frequency, round(r.class_weight, 4), r.scale_pos_weight) for r in evaluate.class_weights(df).collect()}
    assert got == {0: (3, 0.75, 1.3333, 3.0), 1: (1, 0.25, 4.0, 3.0)}


def test_patience():
    falling = [1.0 - i / 1000 for i in range(706)]
    assert training.best_with_patience([*falling, *[0.9] * 50, 0.0], 50) == (706, True)
    assert training.best_with_patience([*falling, *[0.9] * 48, 0.0], 50) == (755, False)
    assert training.best_with_patience([3.0, 2.0, 2.5], 50) == (2, False)


def test_patience_on_a_table(spark):
    losses = {"a": [1.0 - i / 1000 for i in range(706)] + [0.9] * 50 + [0.0], "b": [3.0, 2.0, 2.5]}
    curve = spark.createDataFrame([(i, s, x) for s, values in losses.items() for i, x in enumerate(values)],
                                  "iteration int, split string, logloss double")
    got = {r.split: r.iteration + 1 for r in training.best_iterations(curve, 50).collect()}
    assert got == {s: training.best_with_patience(v, 50)[0] for s, v in losses.items()} == {"a": 706, "b": 2}


def test_column_kinds_and_preparation(spark):
    df = spark.createDataFrame([("d", "New Customer", None, None, 2, None)],
                               "device_id string, customer_status string, install_date date, platform string, opens int, rate double")
    assert features.feature_types(df) == (["device_id", "customer_status", "platform"], ["opens", "rate"])
    row = features.prepare_features(df, features.new_customer_label(), keep=["device_id"], fills={"rate": 0.0}).first()
    assert row.asDict() == {"device_id": "d", "label": 1, "platform": "missing", "opens": 2.0, "rate": 0.0}
    marked = features.mark_unavailable(spark.createDataFrame([("ANDROID", 3), ("IOS", 3), ("IOS", None)], "platform string, n int"), ["n"])
    assert [r.n for r in marked.collect()] == ["non_available", "3", None]


def test_split_keeps_keys_together_and_is_stable(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("k"))
    split = features.assign_split(df, "k", 20)
    assert split.groupBy("k").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = split.where("split = 'validation'").count() / 4000
    assert 0.15 < share < 0.25


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(600):
        kind, city, x = rng.choice("abc"), f"city{rng.randint(0, 40)}", rng.random()
        p = 0.15 + 0.5 * (kind == "a") + 0.25 * (x > 0.5)
        data.append((f"k{i}", int(rng.random() < p), kind, city, x))
    df = spark.createDataFrame(data, "key string, label int, kind string, city string, x double")
    return features.assign_split(df, "key", 30).persist()


PARAMS = training.TrainingParams(iterations=4, depth=3, patience=50, max_bins=32)


@pytest.fixture(scope="module")
def model(rows):
    return training.train(rows, key="key", params=PARAMS)


def test_training_learns_and_encodes_categories_by_rate(model, rows):
    assert [s.column for s in model.statistics] == ["kind", "city"] and model.numbers == ["x"]
    losses = model.learning_losses["train"]
    assert len(losses) == 4 and all(b < a for a, b in zip(losses, losses[1:]))
    assert model.best_iteration == training.best_with_patience(model.learning_losses["validation"], 50)[0]
    assert len(model.trees.trees) == model.best_iteration and len(model.grown.trees) == 4
    result = evaluate.binary_metrics(model.score(rows.where("split = 'validation'"))).first()
    assert result.roc_auc > 0.65


def test_training_stops_when_patience_runs_out(rows):
    params = training.TrainingParams(iterations=60, depth=4, patience=3, max_bins=32)
    model = training.train(rows, key="key", params=params)
    losses = model.learning_losses["validation"]
    best, stopped = training.best_with_patience(losses, 3)
    # Each tree is fitted once: the best ones and those that patience waited for.
    assert stopped and len(model.grown.trees) == len(losses) == best + 3 and len(model.trees.trees) == model.best_iteration == best


@pytest.mark.parametrize("weighting, weights", [("scale_pos_weight", (3.0, 1.0)), ("class_weights", (4.0, 4 / 3)), ("none", (1.0, 1.0))])
def test_row_weights(spark, weighting, weights):
    df = spark.createDataFrame([(1,), (0,)], "label int")
    got = [r[0] for r in df.select(training.row_weight(F.col("label"), 1, 3, weighting)).collect()]
    assert got == pytest.approx(list(weights))


def test_out_of_fold_rates_leave_the_own_fold_out(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 1), ("a", 1, 0), ("b", 1, 1)], "c string, fold int, label int")
    stats = training.category_statistics(df, "c", "label", PARAMS, prior=0.5)
    got = {(r.c, r.fold): r["c__rate"] for r in stats.encode_out_of_fold(df).collect()}
    assert got == {("a", 0): (0 + 0.5) / 2, ("a", 1): (2 + 0.5) / 3, ("b", 1): 0.5}
    missing = spark.createDataFrame([(None, 0), (None, 1), ("z", 0)], "c string, fold int")
    assert [r["c__rate"] for r in stats.encode_out_of_fold(missing).collect()] == [0.5] * 3
    unseen = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [round(r["c__rate"], 6) for r in stats.encode(unseen).orderBy(F.col("c").asc_nulls_last()).collect()] == [0.625, 0.5, 0.5]


def test_validation_rows_are_encoded_as_scored_rows(spark, rows):
    train, other = rows.where("split = 'train'"), rows.where("split = 'validation'").union(
        spark.createDataFrame([("new", 1, None, "nowhere", 0.5, "validation")], rows.schema))
    counts, statistics = training.all_statistics(train, ["kind", "city"], "label", PARAMS, 0.4)
    got = {tuple(r) for r in training.known_rates(other, ["kind", "city"], counts, "key", 0.4).collect()}
    plain = other
    for s in statistics:
        plain = s.encode(plain, ["key"])
    assert {(k, round(a, 12), round(b, 12)) for k, a, b in got} == {
        (r["key"], round(r["kind__rate"], 12), round(r["city__rate"], 12)) for r in plain.collect()}
    assert ("new", 0.4, 0.4) in got


def test_scored_rows_are_joined_with_all_rates_at_once(spark, rows):
    """Whatever the number of text columns; rows may repeat, values be missing or new, and counts lie in several folds."""
    counted = rows.where("split = 'train'").withColumn("fold", F.length("key") % 2)
    statistics = [training.category_statistics(counted, c, "label", PARAMS, prior) for c, prior in [("kind", 0.3), ("city", 0.6)]]
    other = spark.createDataFrame([("new", 1, None, "nowhere", 0.5, "validation"), ("new", 1, None, None, 0.5, "validation")], rows.schema)
    df = rows.union(rows.where("split = 'validation'")).union(other)
    got, plain = training.with_rates(df, statistics), df
    for s in statistics:
        plain = s.encode(plain, ["key"])
    assert got.columns == plain.columns and got.count() == df.count()
    assert got.exceptAll(plain).count() == 0 == plain.exceptAll(got).count()
    more = [training.CategoryStatistics(f"c{i}", s.table.withColumnRenamed(s.column, f"c{i}"), s.prior, 1.0)
            for i, s in enumerate(statistics * 4)]
    wide = df.select("*", *[F.col(s.column).alias(f"c{i}") for i, s in enumerate(statistics * 4)])
    model = training.ConversionModel(oblivious.Trees([], []), [], more)
    assert model.encode(wide)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert training.with_rates(df, []) is df


def test_save_and_load_score_the_same(model, rows, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = training.ConversionModel.load(str(tmp_path / "m"))
    a, b = model.score(rows), loaded.score(rows)
    assert a.join(b.select("key", F.col("score").alias("again")), "key").where("score <> again").count() == 0
    assert loaded.feature_names == model.feature_names


def test_importance_sums_to_100(model):
    got = training.feature_importance(model).collect()
    assert abs(sum(r.importance for r in got) - 100) < 1e-6 and got[0].feature == "kind"


def test_training_needs_both_classes(spark):
    df = spark.createDataFrame([("k", 1, 0.5, "train")], "key string, label int, x double, split string")
    with pytest.raises(ValueError):
        training.train(df, key="key")
