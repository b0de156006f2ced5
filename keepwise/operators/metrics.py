"""Evaluation metrics J1-J8, exact, from one group-by-score table.

Ranking metrics need prefix sums over scores in descending order. Rows are
first grouped by distinct score (partial aggregation: a score shared by a
third of the rows collapses on the map side), then running totals over the
distinct scores come from range-partitioned parallel prefix sums
(``functions.prefix``), never from a single-task window.

With per-score counts (pos_k, neg_k) and running totals (tp_k, fp_k) in
descending score order, P positives and N negatives:

    average precision = sum_k pos_k * tp_k / (tp_k + fp_k) / P
    ROC AUC           = sum_k neg_k * (tp_k - pos_k / 2) / (P * N)

(steps between distinct thresholds; tied scores count half for ROC).
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise import constants as K

from keepwise.functions.numeric import round_half_even
from keepwise.functions.prefix import running_totals

DIGITS = 9      # float sums depend on order; reported metrics are rounded


def score_groups(df: DataFrame, score: str = "churn_probability", label: str = "churned",
                 threshold: float = 0.5, hit: Column | None = None, by: list[str] = ()) -> DataFrame:
    """(score, pos, neg, pos_hit, neg_hit) per distinct score (and ``by``
    group); ``hit`` is the hard prediction (default ``score >= threshold``)."""
    y = F.col(label).cast("long")
    h = (hit if hit is not None else F.col(score) >= F.lit(threshold)).cast("long")
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"),
        F.sum(y * h).alias("pos_hit"), F.sum((F.lit(1) - y) * h).alias("neg_hit"),
    )


def with_running(groups: DataFrame, by: list[str] = ()) -> DataFrame:
    """Add tp/fp = positives/negatives at or above each score (per ``by`` group)."""
    return running_totals(groups, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")},
                          restart_by=list(by) or None)


def _ranking_aggs() -> list[Column]:
    p_tot, n_tot = F.sum("pos"), F.sum("neg")
    tp_at, fp_at = F.sum("pos_hit"), F.sum("neg_hit")
    return [
        p_tot.alias("P"), n_tot.alias("N"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap_sum"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))).alias("roc_sum"),
        tp_at.alias("tp_t"), fp_at.alias("fp_t"),
        F.sum(F.col("pos") * F.pow(F.col("score") - F.lit(1.0), 2) + F.col("neg") * F.pow(F.col("score"), 2)).alias("sq_sum"),
    ]


def _nz(b: Column) -> Column:
    """Divisor or NULL when it is 0: an undefined ratio is missing, not an
    ANSI error (pandas would give NaN)."""
    return F.when(b != 0, b)


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 (zero_division=0)."""
    return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))


def _finish(agg: DataFrame, by: list[str] = ()) -> DataFrame:
    P, N = F.col("P"), F.col("N")
    tp, fp = F.col("tp_t"), F.col("fp_t")
    fn, tn = P - tp, N - fp
    r = lambda c: round_half_even(c, DIGITS)
    return agg.select(
        *by,
        r(F.when(P > 0, F.col("ap_sum") / P).otherwise(F.lit(0.0))).alias("pr_auc"),
        r(F.when((P > 0) & (N > 0), F.col("roc_sum") / (P * N))).alias("roc_auc"),
        _div0(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"),
        _div0(tp.cast("double"), (tp + fp).cast("double")).alias("precision"),
        _div0(tp.cast("double"), (tp + fn).cast("double")).alias("recall"),
        ((tp + tn) / (P + N)).alias("accuracy"),
        r(F.col("sq_sum") / (P + N)).alias("brier"),
    )


def score_metrics(df: DataFrame, score: str = "churn_probability", label: str = "churned",
                  threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    """The seven metrics in one row (PR-AUC, ROC-AUC, F1, precision,
    recall, accuracy, Brier); one row per ``by`` group when given.

    Rows without a score or label are left out, as in J3 and J4."""
    by = list(by)
    df = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    run = with_running(score_groups(df, score, label, threshold, by=by), by)
    agg = run.groupBy(*by).agg(*_ranking_aggs()) if by else run.agg(*_ranking_aggs())
    return _finish(agg, by)


def average_precision(df: DataFrame, score: str = "churn_probability", label: str = "churned") -> DataFrame:
    """Step-wise average precision (not the interpolated areaUnderPR)."""
    return score_metrics(df, score, label).select("pr_auc")


def roc_auc(df: DataFrame, score: str = "churn_probability", label: str = "churned") -> DataFrame:
    """ROC AUC, ties count half."""
    return score_metrics(df, score, label).select("roc_auc")


def threshold_counts(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    y = F.col(label)
    pred = F.col(score) >= F.lit(threshold)
    return df.agg(
        F.count_if(pred & (y == 1)).alias("tp"), F.count_if(pred & (y == 0)).alias("fp"),
        F.count_if(~pred & (y == 1)).alias("fn"), F.count_if(~pred & (y == 0)).alias("tn"),
    )


def threshold_metrics(df: DataFrame, score: str = "churn_probability", label: str = "churned",
                      threshold: float = 0.5) -> DataFrame:
    """F1, precision, recall, accuracy at p >= threshold; 0 when undefined."""
    c = threshold_counts(df, score, label, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn",
        _div0(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"),
        _div0(tp.cast("double"), (tp + fp).cast("double")).alias("precision"),
        _div0(tp.cast("double"), (tp + fn).cast("double")).alias("recall"),
        ((tp + tn) / _nz(tp + fp + fn + tn)).alias("accuracy"),
    )


def brier(df: DataFrame, score: str = "churn_probability", label: str = "churned") -> DataFrame:
    """Mean squared error of the probability."""
    return df.agg(round_half_even(F.avg(F.pow(F.col(score) - F.col(label), 2)), DIGITS).alias("brier"))


def metrics_long(wide: DataFrame, keep: list[str] = (), **labels: str) -> DataFrame:
    """Wide metric row(s) -> long (…labels, …keep, metric, value)."""
    present = [n for n in K.METRIC_NAMES if n in wide.columns]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in present])
    return wide.select(*[F.lit(v).alias(k) for k, v in labels.items()], *keep, F.inline(pairs))


# --- baselines ------------------------------------------------------------------

def majority_baseline(train: DataFrame, test: DataFrame, label: str = "churned") -> DataFrame:
    """The class of the rounded train mean (half to even) for every test
    row; PR-AUC = test prevalence (one tied score); ROC-AUC fixed at 0.5.

    One aggregate over both tables. Without training rows no row is predicted
    positive; without test rows the ratios are NULL and F1 is 0.
    """
    seen = F.col("__test")
    rows = train.select(F.col(label).alias("__y"), F.lit(False).alias("__test")).unionAll(
        test.select(F.col(label).alias("__y"), F.lit(True).alias("__test")))
    counts = rows.agg(F.coalesce(F.rint(F.avg(F.when(~seen, F.col("__y")))), F.lit(0.0)).alias("always"),
                      F.count_if(seen & (F.col("__y") == 1)).alias("pos"), F.count_if(seen & (F.col("__y") == 0)).alias("neg"))
    yes = F.col("always") >= 0.5
    total = _nz(F.col("pos") + F.col("neg"))
    tp, wrong = F.when(yes, F.col("pos")).otherwise(0), F.when(yes, F.col("neg")).otherwise(F.col("pos"))
    return counts.select(
        F.lit("Majority class").alias("name"),
        (F.when(yes, F.col("pos")).otherwise(F.col("neg")) / total).alias("accuracy"),
        _div0(F.lit(2.0) * tp, F.lit(2.0) * tp + wrong).alias("f1"),
        (F.col("pos") / total).alias("pr_auc"),
        F.lit(0.5).alias("roc_auc"),
    )


INACTIVITY_PROBS = [float(x) for x in np.linspace(0.1, 0.9, 17)]


def inactivity_candidates(train: DataFrame, col: str = "last_login_days", label: str = "churned") -> DataFrame:
    """The 17 candidate cuts (train quantiles 0.10 .. 0.90) with the F1 of
    ``x >= cut``; all counts in one conditional-aggregate pass; the first cut
    with the strictly best F1 is flagged. No training value, no cut."""
    from keepwise.functions.quantiles import exact_quantiles

    cuts = [t for t in exact_quantiles(train, {col: INACTIVITY_PROBS})[col] if t is not None]
    if not cuts:
        return train.select(F.lit(0).alias("position"), F.lit(0.0).alias("cut"), F.lit(0.0).alias("f1"), F.lit(True).alias("is_best")).limit(0)
    y = F.col(label)
    aggs = [F.count_if(y == 1).alias("P")]
    for i, t in enumerate(cuts):
        pred = F.col(col) >= F.lit(t)
        aggs += [F.count_if(pred & (y == 1)).alias(f"tp{i}"), F.count_if(pred & (y == 0)).alias(f"fp{i}")]
    wide = train.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(t).alias("cut"),
                 _div0(F.lit(2.0) * F.col(f"tp{i}"), F.lit(2.0) * F.col(f"tp{i}") + F.col(f"fp{i}") + (F.col("P") - F.col(f"tp{i}"))).alias("f1"))
        for i, t in enumerate(cuts)
    ])
    long = wide.select(F.inline(rows))
    best = F.max("f1").over(_whole())
    first_best = F.min(F.when(F.col("f1") == best, F.col("position"))).over(_whole())
    return long.select("position", "cut", "f1", (F.col("position") == first_best).alias("is_best"))


def _whole():
    return Window.partitionBy()   # over the 17 candidate rows only


def best_inactivity_cut(train: DataFrame, col: str = "last_login_days", label: str = "churned") -> float | None:
    best = inactivity_candidates(train, col, label).where("is_best").first()
    return best["cut"] if best else None


def inactivity_baseline(train: DataFrame, test: DataFrame, col: str = "last_login_days",
                        label: str = "churned") -> DataFrame:
    """accuracy/F1 of ``x >= cut`` on test; PR/ROC-AUC of x / max(test max, 1)
    clipped to [0, 1]; the name carries the cut. Without a cut (no training
    value) no row is predicted positive."""
    cut = best_inactivity_cut(train, col, label)
    top = test.agg(F.greatest(F.max(F.col(col).cast("double")), F.lit(1.0)).alias("m")).first()["m"]
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(col) / F.lit(top)))
    hit = F.lit(False) if cut is None else F.col(col) >= F.lit(cut)
    groups = score_groups(test.withColumn("__p", p), "__p", label, hit=hit)
    m = _finish(with_running(groups).agg(*_ranking_aggs()))
    name = "Inactive: no cut" if cut is None else f"Inactive >= {cut:.0f} days"
    return m.select(F.lit(name).alias("name"), "accuracy", "f1", "pr_auc", "roc_auc")
