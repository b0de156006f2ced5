"""Descriptive aggregation E1-E21 and the design-document extras L1-L3, L7, L8.

Every operator is one scan: conditional aggregates, grouping sets or an
unpivot feeding a single group-by (partial aggregation on the map side keeps
hot groups from reaching one task whole). Outputs are tiny tables.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions import columns as C
from keepwise.functions.literals import literal_table
from keepwise.functions.numeric import round_half_even


def _money_sum(cond: Column | None = None, col: str = "monthly_fee") -> Column:
    v = C.money(col)
    return F.sum(v if cond is None else F.when(cond, v)).cast("double")


def _churned() -> Column:
    return F.col(K.TARGET) == 1


#: the three KPI views of the BI layer: their keys, what they tell, and their order; SQL expressions, from which
#: both the operators and the stored views are made
_MRR = "CAST(SUM(CAST(monthly_fee AS DECIMAL(18,2))) AS DOUBLE)"
KPI_VIEWS = {
    "vw_kpi_summary": ([], {
        "total_subscribers": "COUNT(1)", "total_revenue_mrr": _MRR, "overall_churn_rate": f"AVG({K.TARGET})",
        "avg_monthly_fee": f"{_MRR} / NULLIF(COUNT(monthly_fee), 0)"}, None),
    "vw_revenue_by_plan": (["subscription_type"], {
        "subscribers": "COUNT(1)", "revenue_mrr": _MRR, "churn_rate": f"AVG({K.TARGET})"}, "revenue_mrr"),
    "vw_churn_by_segment": (["subscription_type", "region"], {
        "subscribers": "COUNT(1)", "churn_rate": f"AVG({K.TARGET})"}, "churn_rate"),
}


def _kpi_view(df: DataFrame, name: str, dims: list[str] | None = None) -> DataFrame:
    keys, metrics, first = KPI_VIEWS[name]
    keys = keys if dims is None else dims
    out = df.groupBy(*keys).agg(*[F.expr(x).alias(n) for n, x in metrics.items()])
    return out.orderBy(F.desc(first), *keys) if first else out


def kpi_view_sql(name: str, table: str) -> str:
    """The SELECT of a KPI view over ``table``."""
    keys, metrics, first = KPI_VIEWS[name]
    text = f"SELECT {', '.join([*keys, *[f'{x} AS {n}' for n, x in metrics.items()]])} FROM {table}"
    return text + (f" GROUP BY {', '.join(keys)} ORDER BY {first} DESC, {', '.join(keys)}" if keys else "")


def kpi_summary(df: DataFrame) -> DataFrame:
    """The KPI view."""
    return _kpi_view(df, "vw_kpi_summary")


def revenue_by_plan(df: DataFrame) -> DataFrame:
    """The revenue-by-plan view, highest revenue first."""
    return _kpi_view(df, "vw_revenue_by_plan")


def churn_by_segment(df: DataFrame, dims: tuple[str, ...] = ("subscription_type", "region")) -> DataFrame:
    """The churn-by-segment view, highest rate first."""
    return _kpi_view(df, "vw_churn_by_segment", list(dims))


def executive_kpis(df: DataFrame) -> DataFrame:
    """Subscribers, MRR, churn %, average fee, MRR of churners and its share."""
    mrr, lost = _money_sum(), _money_sum(_churned())
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("subscribers"),
        mrr.alias("mrr"),
        (F.avg(K.TARGET) * F.lit(100.0)).alias("churn_pct"),
        (mrr / F.nullif(F.count("monthly_fee"), F.lit(0))).alias("avg_fee"),
        F.coalesce(lost, F.lit(0.0)).alias("lost_mrr"),
        (F.coalesce(lost, F.lit(0.0)) / F.when(mrr != 0, mrr) * F.lit(100.0)).alias("lost_share_pct"),
    )


def key_signals(df: DataFrame) -> DataFrame:
    """E5: churn % of Basic plan, Dormant recency, Low engagement, in one pass."""
    def pct(cond):
        return F.avg(F.when(cond, F.col(K.TARGET))) * F.lit(100.0)

    return df.agg(
        pct(F.col("subscription_type") == "Basic").alias("basic_churn_pct"),
        pct(F.col("recency_bucket") == "Dormant").alias("dormant_churn_pct"),
        pct(F.col("engagement_segment") == "Low").alias("low_engagement_churn_pct"),
    )


def _unpivot_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) pairs; values as text, the way the charts read them."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])
    return df.select(F.inline(pairs))


def category_share(df: DataFrame, cols: str | list[str], order: list[str] | None = None) -> DataFrame:
    """Count and share per value, many columns in one group-by.

    With ``order`` the values outside it are dropped, before shares are taken,
    and absent ones omitted.
    """
    long = _unpivot_text(df, [cols] if isinstance(cols, str) else cols)
    if order is not None:
        long = long.where(F.col("value").isin(*order))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("column"))
    return counts.select("column", "value", "count", (F.col("count") / total).alias("share"))


def _domain(df: DataFrame, values: list[str], name: str) -> DataFrame:
    return literal_table(df.sparkSession, [(v, i) for i, v in enumerate(values)], f"{name} string, ordinal int")


def ordered_counts(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Count per value over a fixed domain, absent values count 0."""
    counts = df.groupBy(F.col(col).cast("string").alias(col)).agg(F.count(F.lit(1)).alias("count"))
    dom = _domain(df, order, col)
    return dom.join(counts, col, "left").select(
        col, "ordinal", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )


def churn_rate_by(df: DataFrame, col: str, order: list[str] | None = None) -> DataFrame:
    """Churn % per value; an ordered domain keeps absent values as NULL."""
    rates = df.groupBy(F.col(col).cast("string").alias("value")).agg(
        (F.avg(K.TARGET) * F.lit(100.0)).alias("churn_pct")
    )
    if order is None:
        return rates.select(F.lit(col).alias("dimension"), "value", F.lit(None).cast("int").alias("ordinal"), "churn_pct")
    dom = _domain(df, order, "value")
    return dom.join(rates, "value", "left").select(
        F.lit(col).alias("dimension"), "value", "ordinal", "churn_pct"
    )


def churn_rates(df: DataFrame, dims: list[tuple[str, list[str] | None]]) -> DataFrame:
    """E8 for several (column, order) at once, from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c, _ in dims])
    rates = df.select(K.TARGET, F.inline(pairs)).groupBy("dimension", "value").agg(
        (F.avg(K.TARGET) * F.lit(100.0)).alias("churn_pct"))
    ordered = [(c, v, i) for c, order in dims if order is not None for i, v in enumerate(order)]
    dom = literal_table(df.sparkSession, ordered, "dimension string, value string, ordinal int")
    free = [c for c, order in dims if order is None]
    full = rates.join(dom, (rates["dimension"] == dom["dimension"]) & (rates["value"] == dom["value"]), "full_outer").select(
        F.coalesce(rates["dimension"], dom["dimension"]).alias("dimension"),
        F.coalesce(rates["value"], dom["value"]).alias("value"), "ordinal", "churn_pct")
    return full.where(F.col("ordinal").isNotNull() | F.col("dimension").isin(*free))


def region_metrics(df: DataFrame) -> DataFrame:
    """E9, both metrics from one scan: (metric, region, value)."""
    both = df.groupBy("region").agg(
        round_half_even(F.avg(K.TARGET) * F.lit(100.0), 1).alias("pct"), F.count(F.lit(1)).cast("double").alias("n"))
    rows = [F.struct(F.lit(m).alias("metric"), "region", F.col(c).alias("value")) for m, c in (("Churn %", "pct"), ("Subscribers", "n"))]
    return both.select(F.inline(F.array(*rows)))


def region_metric(df: DataFrame, metric: str = "Churn %") -> DataFrame:
    """Per region churn % rounded to 1 decimal (half to even), or subscriber count."""
    if metric == "Churn %":
        v = round_half_even(F.avg(K.TARGET) * F.lit(100.0), 1)
    else:
        v = F.count(F.lit(1)).cast("double")
    return df.groupBy("region").agg(v.alias("value"))


def region_to_country(metric: DataFrame, countries: DataFrame) -> DataFrame:
    """Spread a region value to every country of that region (inner join).

    Both sides carry the region after the Americas' split (E11).
    """
    return countries.join(metric, "region").select("country", "region", "value")


def country_region(countries: DataFrame, south: list[str] = K.SOUTH_AMERICA, americas: str = "Americas",
                   labels: tuple[str, str] = ("South America", "North America")) -> DataFrame:
    """Split the Americas into South / North by a set of country names."""
    return countries.select(
        "country", "continent",
        F.when(F.col("continent") != americas, F.col("continent"))
        .when(F.col("country").isin(*south), labels[0]).otherwise(labels[1]).alias("region"),
    )


def status_profile(df: DataFrame, feats: list[str] = K.STATUS_FEATURES, digits: int = 9) -> DataFrame:
    """Mean per status / overall mean, long form (feature, status, ratio)."""
    aggs = []
    for f in feats:
        overall = F.avg(f)
        for st in K.STATUS_ORDER:
            aggs.append((F.avg(F.when(F.col("status") == st, F.col(f))) / F.when(overall != 0, overall)).alias(f"{f}|{st}"))
    wide = df.agg(*aggs)
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(st).alias("status"), F.col(f"`{f}|{st}`").alias("ratio"))
        for f in feats for st in K.STATUS_ORDER
    ])
    return wide.select(F.inline(pairs)).select(
        "feature", "status", round_half_even(F.col("ratio"), digits).alias("ratio")
    )


def revenue_tree(df: DataFrame) -> DataFrame:
    """Fee by plan x status with plan subtotals and a grand total."""
    return df.rollup("subscription_type", "status").agg(
        F.grouping_id().cast("int").alias("level"),
        _money_sum().alias("revenue_mrr"),
    )


def plan_mrr(df: DataFrame) -> DataFrame:
    """Fee per plan."""
    return df.groupBy("subscription_type").agg(_money_sum().alias("revenue_mrr"))


def revenue_waterfall(df: DataFrame) -> DataFrame:
    """Total MRR, lost to churn (negative), retained."""
    one = df.agg(_money_sum().alias("total"), F.coalesce(_money_sum(_churned()), F.lit(0.0)).alias("lost"))
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("Total MRR").alias("label"), F.col("total").alias("amount")),
        F.struct(F.lit(2).alias("step"), F.lit("Lost to churn").alias("label"), (-F.col("lost")).alias("amount")),
        F.struct(F.lit(3).alias("step"), F.lit("Retained MRR").alias("label"), (F.col("total") - F.col("lost")).alias("amount")),
    )
    return one.select(F.inline(steps))


def _priority_aggs() -> list[Column]:
    lost = _money_sum(_churned())
    return [
        F.count(F.lit(1)).alias("subscribers"),
        (F.avg(K.TARGET) * F.lit(100.0)).alias("churn_rate"),
        F.coalesce(lost * F.lit(float(K.REVENUE_MONTHS)), F.lit(0.0)).alias("arr_at_risk"),
    ]


def priority_table(df: DataFrame, dim: str) -> DataFrame:
    """Per value of a dimension: size, churn %, annual revenue lost to churn.

    One group-by with a conditional sum (the reference needs two group-bys and
    an outer alignment).
    """
    return df.groupBy(F.col(dim).cast("string").alias("segment")).agg(*_priority_aggs())


def priority_all(df: DataFrame, dims: list[str] = K.PRIORITY_DIMS) -> DataFrame:
    """The priority table over several dimensions in one scan (GROUPING SETS)."""
    g = df.groupingSets([[d] for d in dims], *dims).agg(F.grouping_id().alias("__gid"), *_priority_aggs())
    n = len(dims)
    label, segment = None, None
    for i, d in enumerate(dims):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))   # only column i is grouped
        cond = F.col("__gid") == gid
        label = F.when(cond, F.lit(d)) if label is None else label.when(cond, F.lit(d))
        segment = F.when(cond, F.col(d).cast("string")) if segment is None else segment.when(cond, F.col(d).cast("string"))
    return g.select(label.alias("dimension"), segment.alias("segment"), "subscribers", "churn_rate", "arr_at_risk")


def top_priority(tbl: DataFrame, by: str = "dimension") -> DataFrame:
    """The value with the highest revenue at risk per dimension; ties by name."""
    w = Window.partitionBy(by).orderBy(F.desc("arr_at_risk"), F.asc("segment"))
    return tbl.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def risk_rank(df: DataFrame, dim: str = "subscription_type") -> DataFrame:
    """Priority table ranked by revenue at risk, with the overall churn %.

    The overall rate comes from the grouped table itself (a window over a few
    rows), not from a second scan joined back.
    """
    g = df.groupBy(F.col(dim).cast("string").alias("segment")).agg(
        *_priority_aggs(), F.sum(K.TARGET).alias("__churners")
    )
    everyone = Window.partitionBy()
    ranked = Window.orderBy(F.desc("arr_at_risk"), F.asc("segment"))
    return g.select(
        "segment", "subscribers", "churn_rate", "arr_at_risk",
        (F.sum("__churners").over(everyone) / F.sum("subscribers").over(everyone) * F.lit(100.0)).alias("overall_churn_pct"),
        F.row_number().over(ranked).alias("rank"),
    )


def segment_status(df: DataFrame) -> DataFrame:
    """Count per engagement segment x status."""
    return df.groupBy("engagement_segment", "status").agg(F.count(F.lit(1)).alias("count"))


def engagement_grid(df: DataFrame, hours_width: float = 50.0, days_width: float = 30.0) -> DataFrame:
    """The engagement scatter re-aimed at scale: 2-D binned counts by status."""
    hb = F.floor(F.col("watch_hours") / F.lit(hours_width)) * F.lit(hours_width)
    db = F.floor(F.col("last_login_days") / F.lit(days_width)) * F.lit(days_width)
    return df.groupBy(
        hb.cast("double").alias("hours_bin"), db.cast("double").alias("days_bin"), "status"
    ).agg(F.count(F.lit(1)).alias("count"))


# --- promised in the design (L) ---------------------------------------------

def dim_plan(df: DataFrame) -> DataFrame:
    """L1: plan -> monthly fee, with the number of distinct fees seen (1 = consistent)."""
    return df.groupBy("subscription_type").agg(
        F.min("monthly_fee").alias("monthly_fee"),
        F.count_distinct("monthly_fee").alias("n_fees"),
    )


def dim_lookup(df: DataFrame, cols: str | list[str]) -> DataFrame:
    """L2: lookup tables with surrogate keys (dense rank of the value per column).

    The window is partitioned by column over its distinct values, so its size
    is the column's cardinality (regions, devices, genres), not the row count.
    """
    vals = _unpivot_text(df, [cols] if isinstance(cols, str) else cols).distinct()
    w = Window.partitionBy("column").orderBy("value")
    return vals.select("column", "value", F.dense_rank().over(w).cast("int").alias("key"))


def churn_cube(df: DataFrame, dims: tuple[str, ...] = ("subscription_type", "region", "engagement_segment")) -> DataFrame:
    """L3: churn over every combination of plan, region and engagement (CUBE)."""
    return df.cube(*dims).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("subscribers"),
        F.avg(K.TARGET).alias("churn_rate"),
    )


def domain_check(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Values outside an allowed list, counted per column and value (anti join)."""
    allowed = literal_table(df.sparkSession, [(c, v) for c, vs in domains.items() for v in vs], "column string, value string")
    long = _unpivot_text(df, list(domains))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(allowed, ["column", "value"], "left_anti")


def missing_report(df: DataFrame) -> DataFrame:
    """Missing values per column, one aggregate then an unpivot."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in df.columns])
    return wide.select(F.inline(pairs))
