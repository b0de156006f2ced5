"""Cross-validated evaluation summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.functions.numeric import round_half_even
from keepwise.operators.metrics import metrics_long, score_metrics


def fold_metrics(df: DataFrame, score: str = "churn_probability", label: str = "churned",
                 fold: str = "fold") -> DataFrame:
    """The seven metrics per fold, then mean and population std per metric."""
    per_fold = score_metrics(df, score, label, by=[fold])
    names = ["pr_auc", "roc_auc", "f1", "precision", "recall", "accuracy", "brier"]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    long = per_fold.select(fold, F.inline(pairs))
    return long.groupBy("metric").agg(
        round_half_even(F.avg("value"), 6).alias("mean"),
        round_half_even(F.stddev_pop("value"), 6).alias("std"),
    )


__all__ = ["fold_metrics", "metrics_long"]
