"""Filters, options, sort and top-k D1-D6."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions.numeric import round_half_even
from keepwise.functions.prefix import running_totals


def subscriber_condition(spec: dict):
    """AND of the optional parts of a dashboard filter spec."""
    cond = F.lit(True)
    for col in ("region", "subscription_type", "gender", "engagement_segment"):
        if spec.get(col) is not None:
            cond = cond & F.col(col).isin(*spec[col])
    if spec.get("age") is not None:
        lo, hi = spec["age"]
        cond = cond & F.col("age").between(lo, hi)
    return cond


def filter_subscribers(df: DataFrame, spec: dict) -> DataFrame:
    """region/plan/gender/segment in, age between (inclusive); pushes to the scan
    for stored columns."""
    return df.where(subscriber_condition(spec))


def filter_options(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted distinct values per column, long form (column, value, position)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    vals = df.select(F.inline(pairs)).distinct()
    w = Window.partitionBy("column").orderBy("value")
    return vals.select("column", "value", F.row_number().over(w).alias("position"))


def filter_bounds(df: DataFrame) -> DataFrame:
    """D3: integer age range and the revenue slider bound int(max) + 1."""
    return df.agg(
        F.min("age").cast("int").alias("age_min"),
        F.max("age").cast("int").alias("age_max"),
        (F.max("revenue_at_risk").cast("int") + 1).alias("revenue_max"),
    )


def scored_condition(spec: dict):
    cond = F.lit(True)
    for col in ("risk_tier", "subscription_type", "engagement_segment"):
        if spec.get(col) is not None:
            cond = cond & F.col(col).isin(*spec[col])
    if spec.get("min_revenue") is not None:
        cond = cond & (F.col("revenue_at_risk") >= F.lit(spec["min_revenue"]))
    return cond


def filter_scored(df: DataFrame, spec: dict) -> DataFrame:
    """Tier, plan, segment in; revenue at risk at least a minimum."""
    return df.where(scored_condition(spec))


def customer_table(scored: DataFrame, n: int | None = None) -> DataFrame:
    """Six columns, probability in % (1 decimal, half to even), highest
    revenue at risk first, ties by key.

    With ``n`` it is a top-n (TakeOrderedAndProject). Without, the position of
    every row comes from parallel running counts over a range-partitioned
    order, not from a single-task window.
    """
    cols = [
        K.ID_COL,
        round_half_even(F.col("churn_probability") * F.lit(100.0), 1).alias("churn_probability"),
        "risk_tier", "revenue_at_risk", "key_factor", "recommended_action",
    ]
    order = [F.desc("revenue_at_risk"), F.asc(K.ID_COL)]
    if n is not None:
        top = scored.orderBy(*order).limit(n).select(*cols)
        return top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return running_totals(scored.select(*cols), order, {"position": F.lit(1).cast("bigint")})


def filtered_kpis(df: DataFrame, spec: dict) -> DataFrame:
    """The KPI cards over a filtered set plus "showing n of N", one pass.

    An empty selection is reported (``empty``) and its averages are NULL.
    """
    cond = subscriber_condition(spec)
    fee = F.when(cond, F.col("monthly_fee").cast("decimal(18,2)"))
    shown = F.count_if(cond)
    return df.agg(
        shown.alias("shown"),
        F.count(F.lit(1)).alias("total"),
        F.sum(fee).cast("double").alias("mrr"),
        (F.avg(F.when(cond, F.col(K.TARGET))) * F.lit(100.0)).alias("churn_pct"),
        (F.sum(fee).cast("double") / F.nullif(F.count(fee), F.lit(0))).alias("avg_fee"),
        round_half_even(F.avg(F.when(cond, F.col("watch_hours"))), 9).alias("avg_watch_hours"),
        (shown == 0).alias("empty"),
    )
