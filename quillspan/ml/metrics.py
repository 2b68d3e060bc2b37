"""Metrics as aggregates over (actual, score); tied scores count as one step.

Running counts go over distinct scores that were counted first, in two levels, so neither a
group such as a year nor the whole must fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.scalars import safe_divide
from quillspan.operators.windows import group_totals, running_totals


def _steps(df: DataFrame, actual: str, score: str, by: Sequence[str]) -> DataFrame:
    """Per group and distinct score, from the highest: positives, negatives and running counts."""
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(actual).cast("long")).alias("pos"), F.count("*").alias("n"))
    steps = running_totals(counts, by, "score", {"tp": "pos", "seen": "n"}, descending=True)
    totals = counts.groupBy(*by).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"))
    return group_totals(steps, totals, by, ["all_pos", "all_n"])


def precision_recall(df: DataFrame, actual: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, precision, recall) at each distinct score."""
    steps = _steps(df, actual, score, by)
    return steps.select(*by, "score", F.round(F.col("tp") / F.col("seen"), 6).alias("precision"), F.round(safe_divide("tp", "all_pos"), 6).alias("recall"))


def ranking(df: DataFrame, actual: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, positives, average_precision, roc_auc); null where a class is missing."""
    steps = _steps(df, actual, score, by)
    neg = F.col("n") - F.col("pos")
    below = F.col("all_n") - F.col("all_pos") - (F.col("seen") - F.col("tp"))  # negatives with a lower score
    sums = steps.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("positives"),
        F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"), F.sum(F.col("pos") * (below + neg / 2.0)).alias("u"),
    )
    p, q = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    both = (p > 0) & (q > 0)
    return sums.select(*by, "n", "positives", F.when(p > 0, F.col("ap") / p).alias("average_precision"), F.when(both, F.col("u") / (p * q)).alias("roc_auc"))


def macro_normalized_ap(df: DataFrame, actual: str, score: str, year: str) -> DataFrame:
    """One row: mean over years of (AP - share) / (1 - share), years of one class left out."""
    share = F.col("positives") / F.col("n")
    per = ranking(df, actual, score, [year]).where("positives > 0 and positives < n")
    return per.agg(F.avg((F.col("average_precision") - share) / (1 - share)).alias("macro_normalized_ap"), F.count("*").alias("n_years"))


def probability_losses(actual: Column, p: Column, eps: float = 1e-15) -> dict[str, Column]:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    y = actual.cast("double")
    return {"log_loss": F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))), "brier": F.avg((p - y) * (p - y))}


def confusion(actual: Column, chosen: Column) -> dict[str, Column]:
    """Counts and rates of a binary decision; a zero denominator gives 0."""
    y, c = actual.cast("int") == 1, chosen.cast("int") == 1
    tp, fp, fn, tn = F.count_if(y & c), F.count_if(~y & c), F.count_if(y & ~c), F.count_if(~y & ~c)
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    precision, recall, special = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn, "accuracy": div(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (recall + special) / 2,
        "precision": precision, "recall": recall, "f1": div(2 * tp, 2 * tp + fp + fn),
    }


def regression(actual: Column, predicted: Column) -> dict[str, Column]:
    err = (actual - predicted) * (actual - predicted)
    return {"mse": F.avg(err), "rmse": F.sqrt(F.avg(err)), "r2": 1 - F.sum(err) / F.nullif(F.var_pop(actual) * F.count(actual), F.lit(0.0))}
