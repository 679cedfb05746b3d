"""Assessment of predictions. Input is the long form `review_id, model, prob, actual`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import round_prediction
from lexispark.operators.ranking import running_totals


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def confusion_matrix(pred: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn with accuracy, sensitivity, specificity and kappa."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    counts = pred.groupBy(*by).agg(
        _count(p & a).alias("tp"), _count(p & ~a).alias("fp"), _count(~p & ~a).alias("tn"), _count(~p & a).alias("fn")
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    chance = _ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    accuracy = _ratio(tp + tn, n)
    return counts.select(
        "*",
        accuracy.alias("accuracy"),
        _ratio(tp, tp + fn).alias("sens"),
        _ratio(tn, tn + fp).alias("spec"),
        _ratio(accuracy - chance, 1 - chance).alias("kappa"),
    )


def _score_slots(pred: DataFrame, steps: int, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per position of the score on the grid i/steps: `below` cuts are smaller

    than the score, `reached` cuts are smaller or equal. At most 2 * steps + 3 rows per group, whatever the data.
    """
    p = F.col("prob").cast("double")
    nearest = F.greatest(F.least(F.round(p * steps), F.lit(steps)), F.lit(0)).cast("int")
    cut = nearest / F.lit(float(steps))
    below = nearest + (p > cut).cast("int")
    reached = nearest + (p >= cut).cast("int")
    return pred.groupBy(*by, below.alias("below"), reached.alias("reached")).agg(
        _count(F.col("actual") == 1).alias("pos"), _count(F.col("actual") == 0).alias("neg")
    )


def threshold_sweep(pred: DataFrame, n: int = 100, by: Sequence[str] = ("model",)) -> DataFrame:
    """`model, cut, spec, sens, acc` for the cuts i/n, i = 0..n.

    A score equal to the cut is right for neither class: positives need prob > cut, negatives prob < cut.
    """
    slots = _score_slots(pred, n, by).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    tp = F.sum(F.when(F.col("below") > F.col("i"), F.col("pos")).otherwise(0))
    tn = F.sum(F.when(F.col("reached") <= F.col("i"), F.col("neg")).otherwise(0))
    sums = slots.groupBy(*by, "i").agg(
        tp.alias("tp"), tn.alias("tn"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return sums.select(
        *by,
        (F.col("i") / F.lit(float(n))).alias("cut"),
        _ratio(F.col("tn"), F.col("neg")).alias("spec"),
        _ratio(F.col("tp"), F.col("pos")).alias("sens"),
        _ratio(F.col("tp") + F.col("tn"), F.col("pos") + F.col("neg")).alias("acc"),
    )


def accuracy_by_cut(pred: DataFrame, n: int = 100, by: Sequence[str] = ("model",)) -> DataFrame:
    """`model, cut, acc` for n evenly spaced cuts from 0 to 1, predicting 1 where prob > cut."""
    steps = n - 1
    slots = _score_slots(pred, steps, by).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    right = F.sum(F.when(F.col("below") > F.col("i"), F.col("pos")).otherwise(F.col("neg")))
    return (
        slots.groupBy(*by, "i")
        .agg(right.alias("right"), F.sum(F.col("pos") + F.col("neg")).alias("rows"))
        .select(*by, (F.col("i") / F.lit(float(steps))).alias("cut"), _ratio(F.col("right"), F.col("rows")).alias("acc"))
    )


def max_accuracy(sweep: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return sweep.groupBy(*by).agg(F.max("acc").alias("acc_max"))


def best_cut(sweep: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows of the sweep with the highest accuracy, ties kept (a sweep has one row per cut)."""
    best = F.max("acc").over(Window.partitionBy(*by))
    return sweep.withColumn("_best", best).where("acc = _best").drop("_best")


def apply_best_cut(train_pred: DataFrame, test_pred: DataFrame, n: int = 100) -> DataFrame:
    """`model, cut, acc_train, acc_test`: the cut that is best on train, applied to test (ties: smallest)."""
    chosen = (
        best_cut(accuracy_by_cut(train_pred, n))
        .groupBy("model")
        .agg(F.min("cut").alias("cut"), F.max("acc").alias("acc_train"))
    )
    test = accuracy_by_cut(test_pred, n).withColumnRenamed("acc", "acc_test")
    return chosen.join(test, ["model", "cut"])


def auc(pred: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rank AUC with ties averaged, and the larger of it and its mirror as `auc_symmetric`.

    Equal scores are merged before anything is ordered. The running count of positives is spread over
    range partitions, so a model's scores are never sorted in one task.
    """
    by = list(by)
    merged = pred.groupBy(*by, F.col("prob").cast("double").alias("prob")).agg(
        _count(F.col("actual") == 1).alias("pos"), _count(F.col("actual") == 0).alias("neg")
    )
    ranked = running_totals(merged, ["prob"], ["pos", "neg"], by)
    above = F.col("total_pos") - F.col("cum_pos")
    pairs = F.col("neg").cast("double") * (above + F.col("pos") / F.lit(2.0))
    area = _ratio(F.sum(pairs), F.max("total_pos").cast("double") * F.max("total_neg"))
    return ranked.groupBy(*by).agg(area.alias("auc")).withColumn(
        "auc_symmetric", F.greatest("auc", 1 - F.col("auc"))
    )


def hard_auc(pred: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """AUC of the rounded predictions. With two scores it follows from the four counts, without ranking."""
    hit = round_prediction("prob") == 1
    pos, neg = F.col("actual") == 1, F.col("actual") == 0
    tpr = _ratio(_count(hit & pos), _count(pos))
    fpr = _ratio(_count(hit & neg), _count(neg))
    out = pred.groupBy(*by).agg(((1 + tpr - fpr) / 2).alias("auc"))
    return out.withColumn("auc_symmetric", F.greatest("auc", 1 - F.col("auc")))


def roc_points(sweep: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return sweep.select(*by, "cut", (1 - F.col("spec")).alias("fpr"), F.col("sens").alias("tpr"))


def score_histogram(pred: DataFrame, bins: int = 30) -> DataFrame:
    """Rows per model, actual class and bin 1..bins of the score."""
    bin_ = F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)) + 1
    return pred.groupBy("model", "actual", bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def correct_count(pred: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows whose rounded prediction equals the label."""
    return pred.groupBy(*by).agg(_count(round_prediction("prob") == F.col("actual")).alias("n"))


def assess_runs(pred: DataFrame, by: Sequence[str] = ("approach", "model")) -> DataFrame:
    """`approach, model, acc_max, auc` (the symmetric AUC) per run."""
    by = list(by)
    accuracy = max_accuracy(threshold_sweep(pred, by=by), by)
    areas = auc(pred, by).select(*by, F.col("auc_symmetric").alias("auc"))
    return accuracy.join(areas, by)


def zero_on_failure(pred: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics with 0 for models whose scores sum to zero (a failed fit)."""
    failed = pred.groupBy("model").agg((F.sum("prob") == 0).alias("_failed"))
    values = [c for c in metrics.columns if c != "model"]
    joined = metrics.join(failed, "model", "left")
    return joined.select("model", *[F.when(F.col("_failed"), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in values])
