"""Evaluation of a binary classifier from scored rows.

Every function takes a DataFrame with a 0/1 label and a score (or prediction)
and returns a small DataFrame. Scores are first counted per distinct value, so
the work after that depends on the number of different scores, not of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conversion_engine.functions.semantics import div0, flag
from conversion_engine.session import materialize


#: Ranges of scores that are summed side by side.
SLICES = 32


def predicted_class(score: str = "score", threshold: float = 0.5) -> Column:
    """1 where the score is above the threshold; a score equal to it is 0."""
    return flag(F.col(score) > threshold)


def threshold_predictions(scored: DataFrame, score: str = "score", threshold: float = 0.5,
                          out: str = "prediction") -> DataFrame:
    return scored.withColumn(out, predicted_class(score, threshold))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class: rows, frequency, inverse frequency; and negatives per positive."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    rows = n.select("n0", "n1", F.expr("stack(2, 0, n0, 1, n1) as (label, rows)"))
    total = F.col("n0") + F.col("n1")
    return rows.select(
        "label", "rows",
        F.try_divide(F.col("rows").cast("double"), total).alias("frequency"),
        F.try_divide(total.cast("double"), F.col("rows")).alias("class_weight"),
        F.try_divide(F.col("n0").cast("double"), F.col("n1")).alias("scale_pos_weight"),
    )


def log_loss(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mean logistic loss and rows of each class. Scores of 0 and 1 count as just inside."""
    p = F.greatest(F.least(F.col(score), F.lit(1 - 1e-15)), F.lit(1e-15))
    return scored.groupBy(F.col(label).alias("label")).agg(
        (-F.avg(F.log(F.when(F.col(label) == 1, p).otherwise(1 - p)))).alias("logloss"), F.count("*").alias("rows"))


def _cells(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """True/false negatives and positives as one row."""
    def cell(truth: int, predicted: int) -> Column:
        return F.count_if((F.col(label) == truth) & (F.col(prediction) == predicted))

    return scored.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _f1(precision: Column, recall: Column) -> Column:
    return div0(2 * precision * recall, precision + recall)


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """All four cells: rows, share of the true class, share of all."""
    cells = _cells(scored, label, prediction).select(
        (F.col("tn") + F.col("fp")).alias("n0"), (F.col("fn") + F.col("tp")).alias("n1"),
        F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (label, prediction, rows)"))
    own = F.when(F.col("label") == 0, F.col("n0")).otherwise(F.col("n1"))
    return cells.select("label", "prediction", "rows", div0("rows", own).alias("share_of_class"),
                        div0("rows", F.col("n0") + F.col("n1")).alias("share_of_all"))


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages."""
    c = _cells(scored, label, prediction).select(
        "*", (F.col("tn") + F.col("fp")).alias("s0"), (F.col("fn") + F.col("tp")).alias("s1"))
    c = c.select(
        "s0", "s1", (F.col("s0") + F.col("s1")).alias("n"),
        div0("tn", F.col("tn") + F.col("fn")).alias("p0"), div0("tn", "s0").alias("r0"),
        div0("tp", F.col("tp") + F.col("fp")).alias("p1"), div0("tp", "s1").alias("r1"),
        div0(F.col("tn") + F.col("tp"), F.col("s0") + F.col("s1")).alias("acc"))
    c = c.select("*", _f1(F.col("p0"), F.col("r0")).alias("f0"), _f1(F.col("p1"), F.col("r1")).alias("f1"))

    def macro(m: str) -> str:
        return f"({m}0 + {m}1) / 2"

    def weighted(m: str) -> str:
        return f"coalesce(try_divide({m}0 * s0 + {m}1 * s1, n), 0D)"

    null = "cast(null as double)"
    return c.select(F.expr(f"""stack(5,
        '0', p0, r0, f0, s0,
        '1', p1, r1, f1, s1,
        'accuracy', {null}, {null}, acc, n,
        'macro avg', {macro('p')}, {macro('r')}, {macro('f')}, n,
        'weighted avg', {weighted('p')}, {weighted('r')}, {weighted('f')}, n
        ) as (class, precision, recall, f1_score, support)"""))


# --- ranking ---------------------------------------------------------------


def score_counts(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score."""
    return scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def _cumulated(counts: DataFrame, slices: int = SLICES) -> DataFrame:
    """Counts with running totals from the highest score down, and the next row's counts.

    The distinct scores are cut into ``slices`` ranges of about equal size. Each
    range is summed in its own task and starts from the totals of the ranges
    above it; only the totals, one row per range, are put in one order.
    """
    counts = materialize(counts, "score_counts")
    cuts = counts.approxQuantile("score", [i / slices for i in range(slices)], 0.001)
    # A score's slice is the number of cuts up to it: equal scores share one.
    sliced = counts.withColumn("slice", sum(((F.col("score") >= c).cast("int") for c in sorted(set(cuts))), F.lit(0)))
    top = F.max_by(F.struct("pos", "neg"), "score")
    totals = sliced.groupBy("slice").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), top.alias("top"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("slice"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "slice",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("neg_above"),
        F.lead("top").over(down).alias("next_slice"),
        F.sum("p").over(Window.partitionBy(F.lit(0))).alias("positives"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("negatives"),
    )
    inside = Window.partitionBy("slice").orderBy(F.desc("score"))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sliced.join(starts, "slice").select(
        "score", "pos", "neg", "positives", "negatives",
        (F.col("pos_above") + F.sum("pos").over(running)).alias("tp"),
        (F.col("neg_above") + F.sum("neg").over(running)).alias("fp"),
        F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("next_slice")).alias("next"),
    )


def roc_points(scored: DataFrame, label: str = "label", score: str = "score",
               drop_intermediate: bool = True, slices: int = SLICES) -> DataFrame:
    """Points of the ROC curve: ``threshold``, ``fpr``, ``tpr``; rows at or above the threshold are positive.

    With ``drop_intermediate`` points on a straight line between their
    neighbours are left out. The curve starts at an infinite threshold.
    """
    rows = _cumulated(score_counts(scored, label, score), slices)
    if drop_intermediate:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bend = F.col("next").isNull() | (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
        rows = rows.where(first | bend)
    points = rows.select(F.col("score").alias("threshold"),
                         F.try_divide(F.col("fp").cast("double"), F.col("negatives")).alias("fpr"),
                         F.try_divide(F.col("tp").cast("double"), F.col("positives")).alias("tpr"))
    start = points.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", slices: int = SLICES) -> DataFrame:
    """Area under the ROC curve by ranks; tied scores count half. NULL with a single class."""
    rows = _cumulated(score_counts(scored, label, score), slices)
    below = F.col("negatives") - F.col("fp")
    wins = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2))
    pairs = F.max("positives").cast("double") * F.max("negatives")
    return rows.agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def binary_metrics(scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5,
                   digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC AUC as one rounded row.

    The cells of the confusion matrix are sums over the distinct scores, so
    the rows are counted once for all five numbers.
    """
    rows = _cumulated(score_counts(scored, label, score))
    hit = F.col("score") > threshold

    def total(column: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    below = F.col("negatives") - F.col("fp")
    c = rows.agg(
        total("neg", ~hit).alias("c_tn"), total("neg", hit).alias("c_fp"),
        total("pos", ~hit).alias("c_fn"), total("pos", hit).alias("c_tp"),
        F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2)).alias("wins"))
    positives, negatives = F.col("c_tp") + F.col("c_fn"), F.col("c_tn") + F.col("c_fp")
    c = c.select(
        div0(F.col("c_tp") + F.col("c_tn"), positives + negatives).alias("accuracy"),
        div0("c_tp", F.col("c_tp") + F.col("c_fp")).alias("precision"),
        div0("c_tp", positives).alias("recall"),
        F.try_divide(F.col("wins"), positives.cast("double") * negatives).alias("roc_auc"))
    f1 = _f1(F.col("precision"), F.col("recall"))
    return c.select(*[F.round(v, digits).alias(n) for n, v in (
        ("accuracy", F.col("accuracy")), ("precision", F.col("precision")), ("recall", F.col("recall")),
        ("f1_score", f1), ("roc_auc", F.col("roc_auc")))])
