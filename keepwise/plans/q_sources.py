"""Registered queries A1-A6: each writes Spark-derived data and reads it back."""
from __future__ import annotations

from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.operators import metrics as M, scoring
from keepwise.plans import fixtures as fx
from keepwise.plans.oracle_ctes import with_ctes
from keepwise.plans.q_clean import clean_sql
from keepwise.plans.q_metrics import SCORED_METRICS
from keepwise.plans.registry import query
from keepwise.sources import io

_NA = ", ".join("'" + t.replace("'", "''") + "'" for t in K.CSV_NA_TOKENS)
_RAW = fx.RAW_COLUMNS


@query("a1_csv_source", with_ctes("raw") + "SELECT " + ", ".join(
    f"CASE WHEN CAST({c} AS VARCHAR) IN ({_NA}) THEN NULL ELSE CAST({c} AS VARCHAR) END AS {c}" for c in _RAW)
    + " FROM raw")
def a1(spark, sf):
    path = io.shared_path(spark, io.tag(sf), "raw_csv")
    io.write_raw_csv(fx.raw_table(spark, sf), path)
    return io.read_raw_csv(spark, path)


#: a text column with quotes, commas and line breaks in the rows of even ids
_LINES_SQL = "CASE WHEN CAST(customer_id AS BIGINT) % 2 = 0 THEN device || chr(10) || '\"' || region || '\", ' || chr(10) ELSE device END"


@query("a1_quoted_csv", with_ctes("raw") + "SELECT " + ", ".join(
    f"CASE WHEN {x} IN ({_NA}) THEN NULL ELSE {x} END AS {c}"
    for c in _RAW for x in [_LINES_SQL if c == "device" else f"CAST({c} AS VARCHAR)"]) + " FROM raw")
def a1_quoted(spark, sf):
    """A1 over fields with line breaks, from files cut into splits."""
    path = io.shared_path(spark, io.tag(sf), "raw_quoted_csv")
    raw = fx.raw_table(spark, sf)
    broken = F.concat("device", F.lit('\n"'), "region", F.lit('", \n'))
    even = F.col("customer_id").cast("bigint") % 2 == 0
    io.write_raw_csv(raw.withColumn("device", F.when(even, broken).otherwise(F.col("device"))), path)
    return io.read_raw_csv(spark, path, _RAW, multi_line=True).select(*_RAW)


@query("a2_clean_sink", clean_sql())
def a2(spark, sf):
    path = io.shared_path(spark, io.tag(sf), "clean")
    io.write_clean(fx.clean_table(spark, sf), path)
    return io.read_clean(spark, path)


@query("a3_fact_table", clean_sql())
def a3(spark, sf):
    return io.save_fact(fx.clean_table(spark, sf), "fact_subscriber")


_VIEW_MONEY = "CAST(SUM(CAST(monthly_fee AS DECIMAL(18,2))) AS DOUBLE)"


def _view_rows(view: str, by: list[str], metrics: dict[str, str]) -> str:
    """A view's contents in long form."""
    keys = ", ".join(c if c in by else f"CAST(NULL AS VARCHAR) AS {c}" for c in ("subscription_type", "region"))
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return " UNION ALL ".join(
        f"SELECT '{view}' AS view_name, {keys}, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM r_clean{group}"
        for m, x in metrics.items())


@query("a4_register_views", clean_sql(" UNION ALL ".join([
    _view_rows("vw_kpi_summary", [], {
        "total_subscribers": "COUNT(*)", "total_revenue_mrr": _VIEW_MONEY, "overall_churn_rate": "AVG(churned)",
        "avg_monthly_fee": f"{_VIEW_MONEY} / COUNT(monthly_fee)"}),
    _view_rows("vw_revenue_by_plan", ["subscription_type"], {
        "subscribers": "COUNT(*)", "revenue_mrr": _VIEW_MONEY, "churn_rate": "AVG(churned)"}),
    _view_rows("vw_churn_by_segment", ["subscription_type", "region"], {
        "subscribers": "COUNT(*)", "churn_rate": "AVG(churned)"}),
])))
def a4(spark, sf):
    io.save_fact(fx.clean_table(spark, sf), "fact_subscriber")
    io.register_views(spark, "fact_subscriber")
    return io.view_rows(spark.newSession())   # the views are the catalog's, not this session's


@query("a5_scored_sink", with_ctes("scored") + "SELECT * FROM scored")
def a5(spark, sf):
    path = io.shared_path(spark, io.tag(sf), "scored")
    io.write_scored(fx.scored_fx(spark, sf), path)
    return io.read_scored(spark, path, scoring.SCORED_COLUMNS)


@query("a6_metrics_sink", with_ctes("scored", extra=SCORED_METRICS + [
    "ml AS (UNPIVOT m ON pr_auc, roc_auc, f1, precision, recall, accuracy, brier INTO NAME metric VALUE value)"]) + """
SELECT 'stand_in' AS model, 'all' AS split, metric, CAST(value AS DOUBLE) AS value FROM ml""")
def a6(spark, sf):
    path = io.shared_path(spark, io.tag(sf), "metrics_json")
    report = M.metrics_long(M.score_metrics(fx.scored_fx(spark, sf)), model="stand_in", split="all")
    io.write_metrics(report, path)
    return io.read_metrics(spark, path)

