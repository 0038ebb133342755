"""Classification and regression metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import running_totals, scalar_quantiles


def confusion(df: DataFrame, keys: Sequence[str], truth: Column, guess: Column) -> DataFrame:
    """Counts ``tn, fp, fn, tp`` per group."""

    def count(t: bool, g: bool) -> Column:
        hit = (truth if t else ~truth) & (guess if g else ~guess)
        return F.count(F.when(hit, 1))

    return df.groupBy(*keys).agg(
        count(False, False).alias("tn"),
        count(False, True).alias("fp"),
        count(True, False).alias("fn"),
        count(True, True).alias("tp"),
    )


def with_class_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, Matthews correlation (0 if undefined) and balanced accuracy of the counts."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns(
        {
            "accuracy": (tp + tn) / (tp + tn + fp + fn),
            "mcc": F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den),
            "balanced_accuracy": (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2,
        }
    )


def ranking_metrics(df: DataFrame, keys: Sequence[str], truth: Column, score: str) -> DataFrame:
    """Exact ROC-AUC (ties count half) and step-wise average precision per group.

    Rows are first counted per distinct score; the running counts over the scores come from the
    two-level prefix sum, so one model with billions of distinct scores is fine.
    """
    group = list(keys) or ["_all"]
    counted = (
        df.withColumn("_all", F.lit(0))
        .groupBy(*group, F.col(score).alias("_s"))
        .agg(F.count(F.when(truth, 1)).alias("_p"), F.count(F.when(~truth, 1)).alias("_n"))
    )
    ranked = running_totals(
        counted, group, [F.col("_s").desc()], {"tp": F.col("_p"), "fp": F.col("_n")}, totals=True
    )
    area = F.col("_n") * (F.col("tp") - F.col("_p") / 2)
    step = F.col("_p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    out = ranked.groupBy(*group).agg(
        F.try_divide(F.sum(area), F.first("tp_total") * F.first("fp_total")).alias("roc_auc"),
        F.try_divide(F.sum(step), F.first("tp_total")).alias("avg_precision"),
    )
    return out.select(*keys, "roc_auc", "avg_precision")


def regression_metrics(
    df: DataFrame, keys: Sequence[str], observed: str, predicted: str
) -> DataFrame:
    """Pearson r, RMSE and MAE per group in one pass."""
    err = F.col(observed) - F.col(predicted)
    return df.groupBy(*keys).agg(
        F.corr(observed, predicted).alias("pearson_r"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
    )


def evaluate_classifier(
    df: DataFrame,
    observed: str,
    predicted: str,
    threshold: float | None = None,
    already_binary: bool = False,
    keys: Sequence[str] = (),
) -> DataFrame:
    """All classifier metrics of a scored table.

    Positive truth is ``observed >= threshold`` (median by default, 0.5 for 0/1 truth); positive
    prediction is ``predicted >= 0.5``.
    """
    if already_binary:
        threshold = 0.5
    elif threshold is None:
        threshold = scalar_quantiles(df, observed, [0.5])[0]
    truth = F.col(observed) >= F.lit(float(threshold))
    counts = with_class_metrics(confusion(df, keys, truth, F.col(predicted) >= 0.5))
    ranks = ranking_metrics(df, keys, truth, predicted)
    joined = counts.join(ranks, list(keys)) if keys else counts.withColumn("_j", F.lit(0)).join(
        ranks.withColumn("_j", F.lit(0)), "_j"
    )
    return joined.select(
        *keys, "accuracy", "roc_auc", "avg_precision", "mcc", "tn", "fp", "fn", "tp"
    )


def evaluate_regressor(
    df: DataFrame, observed: str, predicted: str, keys: Sequence[str] = ()
) -> DataFrame:
    return regression_metrics(df, keys, observed, predicted)
