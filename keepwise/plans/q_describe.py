"""Registered queries D1-D6 (filters), E1-E21 (descriptive) and L1-L3, L7, L8."""
from __future__ import annotations

from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions.numeric import sql_round_half_even as srhe
from keepwise.operators import cleaning, descriptive as D, features, filters
from keepwise.plans import fixtures as fx
from keepwise.plans.oracle_ctes import with_ctes
from keepwise.plans.q_clean import CLEAN_CTES, sql_num
from keepwise.plans.registry import query

MONEY = "CAST(SUM(CAST(monthly_fee AS DECIMAL(18,2))) AS DOUBLE)"
LOST = "CAST(SUM(CASE WHEN churned = 1 THEN CAST(monthly_fee AS DECIMAL(18,2)) END) AS DOUBLE)"
PRIORITY = f"COUNT(*) AS subscribers, AVG(churned) * 100.0 AS churn_rate, COALESCE({LOST} * 12.0, 0.0) AS arr_at_risk"

# --- D ------------------------------------------------------------------------

SPEC = {
    "region": ["AFRICA", "ASIA", "EUROPE"],
    "subscription_type": ["Basic", "Premium"],
    "gender": ["Female", "Male"],
    "engagement_segment": ["Low", "High"],
    "age": (25, 60),
}


def _in(col, vals):
    return f"{col} IN (" + ", ".join(f"'{v}'" for v in vals) + ")"


_SPEC_SQL = " AND ".join([_in(c, v) for c, v in SPEC.items() if c != "age"] + ["age BETWEEN 25 AND 60"])


@query("d1_subscriber_filter", with_ctes("sub") + f"""
SELECT customer_id, region, subscription_type, gender, engagement_segment, age FROM sub WHERE {_SPEC_SQL}""")
def d1(spark, sf):
    out = filters.filter_subscribers(fx.sub(spark, sf), SPEC)
    return out.select(K.ID_COL, "region", "subscription_type", "gender", "engagement_segment", "age")


_OPT_COLS = ["region", "subscription_type", "gender"]


@query("d2_filter_options", with_ctes("sub") + " UNION ALL ".join(
    f"SELECT '{c}' AS column, value, CAST(ROW_NUMBER() OVER (ORDER BY value) AS INT) AS position "
    f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM sub) t{i}" for i, c in enumerate(_OPT_COLS)))
def d2(spark, sf):
    return filters.filter_options(fx.sub(spark, sf), _OPT_COLS)


@query("d3_filter_bounds", with_ctes("scored") + """
SELECT CAST(TRUNC(MIN(age)) AS INT) AS age_min, CAST(TRUNC(MAX(age)) AS INT) AS age_max,
       CAST(TRUNC(MAX(revenue_at_risk)) AS INT) + 1 AS revenue_max FROM scored""")
def d3(spark, sf):
    return filters.filter_bounds(fx.scored_fx(spark, sf))


SCORED_SPEC = {"risk_tier": ["High", "Medium"], "subscription_type": ["Basic", "Standard", "Premium"],
               "engagement_segment": ["Low", "Medium"], "min_revenue": 50}
_SSPEC_SQL = " AND ".join([_in(c, SCORED_SPEC[c]) for c in ("risk_tier", "subscription_type", "engagement_segment")]
                          + ["revenue_at_risk >= 50"])


@query("d4_scored_filter", with_ctes("scored") + f"SELECT * FROM scored WHERE {_SSPEC_SQL}")
def d4(spark, sf):
    return filters.filter_scored(fx.scored_fx(spark, sf), SCORED_SPEC)


@query("d5_customer_table", with_ctes("scored") + f"""
SELECT customer_id, {srhe('churn_probability * 100.0', 1)} AS churn_probability, risk_tier, revenue_at_risk,
       key_factor, recommended_action,
       ROW_NUMBER() OVER (ORDER BY revenue_at_risk DESC, customer_id) AS position FROM scored""")
def d5(spark, sf):
    return filters.customer_table(fx.scored_fx(spark, sf))


@query("d6_filtered_kpis", with_ctes("sub") + f"""
SELECT COUNT(*) FILTER (WHERE {_SPEC_SQL}) AS shown, COUNT(*) AS total,
       CAST(SUM(CASE WHEN {_SPEC_SQL} THEN CAST(monthly_fee AS DECIMAL(18,2)) END) AS DOUBLE) AS mrr,
       AVG(CASE WHEN {_SPEC_SQL} THEN churned END) * 100.0 AS churn_pct,
       CAST(SUM(CASE WHEN {_SPEC_SQL} THEN CAST(monthly_fee AS DECIMAL(18,2)) END) AS DOUBLE)
         / COUNT(*) FILTER (WHERE {_SPEC_SQL}) AS avg_fee,
       {srhe(f'AVG(CASE WHEN {_SPEC_SQL} THEN watch_hours END)', 9)} AS avg_watch_hours,
       COUNT(*) FILTER (WHERE {_SPEC_SQL}) = 0 AS empty FROM sub""")
def d6(spark, sf):
    return filters.filtered_kpis(fx.sub(spark, sf), SPEC)


# --- E ------------------------------------------------------------------------

@query("e1_kpi_summary", with_ctes("sub") + f"""
SELECT COUNT(*) AS total_subscribers, {MONEY} AS total_revenue_mrr, AVG(churned) AS overall_churn_rate,
       {MONEY} / COUNT(*) AS avg_monthly_fee FROM sub""")
def e1(spark, sf):
    return D.kpi_summary(fx.sub(spark, sf))


@query("e2_revenue_by_plan", with_ctes("sub") + f"""
SELECT subscription_type, COUNT(*) AS subscribers, {MONEY} AS revenue_mrr, AVG(churned) AS churn_rate
FROM sub GROUP BY subscription_type""")
def e2(spark, sf):
    return D.revenue_by_plan(fx.sub(spark, sf))


@query("e3_churn_by_segment", with_ctes("sub") + """
SELECT subscription_type, region, COUNT(*) AS subscribers, AVG(churned) AS churn_rate
FROM sub GROUP BY subscription_type, region""")
def e3(spark, sf):
    return D.churn_by_segment(fx.sub(spark, sf))


@query("e4_executive_kpis", with_ctes("sub") + f"""
SELECT COUNT(*) AS subscribers, {MONEY} AS mrr, AVG(churned) * 100.0 AS churn_pct, {MONEY} / COUNT(*) AS avg_fee,
       COALESCE({LOST}, 0.0) AS lost_mrr, COALESCE({LOST}, 0.0) / {MONEY} * 100.0 AS lost_share_pct FROM sub""")
def e4(spark, sf):
    return D.executive_kpis(fx.sub(spark, sf))


@query("e5_key_signals", with_ctes("sub") + """
SELECT AVG(CASE WHEN subscription_type = 'Basic' THEN churned END) * 100.0 AS basic_churn_pct,
       AVG(CASE WHEN recency_bucket = 'Dormant' THEN churned END) * 100.0 AS dormant_churn_pct,
       AVG(CASE WHEN engagement_segment = 'Low' THEN churned END) * 100.0 AS low_engagement_churn_pct FROM sub""")
def e5(spark, sf):
    return D.key_signals(fx.sub(spark, sf))


_SHARE_COLS = ["status", "gender", "subscription_type", "device", "payment_method", "favorite_genre", "number_of_profiles"]


@query("e6_category_share", with_ctes("sub", extra=["l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value FROM sub" for c in _SHARE_COLS) + ")"]) + """
SELECT "column", value, COUNT(*) AS count, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY "column") AS share
FROM l GROUP BY "column", value
UNION ALL SELECT "column" || ' (ordered)', value, COUNT(*), COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY "column")
FROM l WHERE "column" = 'subscription_type' AND value IN ('Premium', 'Basic') GROUP BY "column", value""")
def e6(spark, sf):
    s = fx.sub(spark, sf)
    ordered = D.category_share(s, "subscription_type", ["Premium", "Basic"])
    return D.category_share(s, _SHARE_COLS).unionByName(ordered.withColumn("column", F.concat("column", F.lit(" (ordered)"))))


@query("e7_ordered_counts", with_ctes("sub", extra=["""b AS (SELECT CASE WHEN age > 0 AND age <= 25 THEN '<25'
  WHEN age > 25 AND age <= 35 THEN '25-34' WHEN age > 35 AND age <= 45 THEN '35-44'
  WHEN age > 45 AND age <= 55 THEN '45-54' WHEN age > 55 AND age <= 200 THEN '55+' END AS age_band FROM sub)""",
    "dom AS (SELECT * FROM (VALUES ('<25', 0), ('25-34', 1), ('35-44', 2), ('45-54', 3), ('55+', 4)) t(age_band, ordinal))"]) + """
SELECT dom.age_band, CAST(dom.ordinal AS INT) AS ordinal, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM dom LEFT JOIN (SELECT age_band, COUNT(*) AS n FROM b GROUP BY age_band) c ON c.age_band = dom.age_band""")
def e7(spark, sf):
    return D.ordered_counts(features.with_age_band(fx.sub(spark, sf)), "age_band", K.AGE_BAND_LABELS)


def _rate_sql(col, order):
    if order is None:
        return (f"SELECT '{col}' AS dimension, CAST({col} AS VARCHAR) AS value, CAST(NULL AS INT) AS ordinal, "
                f"AVG(churned) * 100.0 AS churn_pct FROM sub GROUP BY {col}")
    vals = ", ".join(f"('{v}', {i})" for i, v in enumerate(order))
    return (f"SELECT '{col}' AS dimension, d.value, CAST(d.ordinal AS INT) AS ordinal, r.churn_pct FROM "
            f"(SELECT * FROM (VALUES {vals}) t(value, ordinal)) d LEFT JOIN "
            f"(SELECT CAST({col} AS VARCHAR) AS value, AVG(churned) * 100.0 AS churn_pct FROM sub GROUP BY {col}) r "
            f"ON r.value = d.value")


_RATE_DIMS = [("subscription_type", None), ("recency_bucket", K.RECENCY_ORDER),
              ("engagement_segment", K.SEGMENT_ORDER), ("region", None)]


@query("e8_churn_rate_by", with_ctes("sub") + " UNION ALL ".join(_rate_sql(c, o) for c, o in _RATE_DIMS))
def e8(spark, sf):
    return D.churn_rates(fx.sub(spark, sf), _RATE_DIMS)


@query("e9_region_metric", with_ctes("sub") + f"""
SELECT 'Churn %' AS metric, region, {srhe('AVG(churned) * 100.0', 1)} AS value FROM sub GROUP BY region
UNION ALL SELECT 'Subscribers' AS metric, region, CAST(COUNT(*) AS DOUBLE) AS value FROM sub GROUP BY region""")
def e9(spark, sf):
    return D.region_metrics(fx.sub(spark, sf))


@query("e10_region_map_join", with_ctes("sub", "countries") + f"""
SELECT c.country, c.region, m.value FROM countries c JOIN
  (SELECT region, {srhe('AVG(churned) * 100.0', 1)} AS value FROM sub GROUP BY region) m ON c.region = m.region""")
def e10(spark, sf):
    return D.region_to_country(D.region_metric(fx.sub(spark, sf)), fx.countries(spark, sf))


@query("e11_country_region_dim", with_ctes("countries") + "SELECT country, continent, region FROM countries")
def e11(spark, sf):
    base = fx.table(spark, sf, "nation").join(
        fx.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")
    ).select(F.col("n_name").alias("country"), F.col("r_name").alias("continent"))
    return D.country_region(base, ["NATION_1", "NATION_6"], americas="AMERICA",
                            labels=("SOUTH AMERICA", "NORTH AMERICA"))


_PROFILE = []
for _f in K.STATUS_FEATURES:
    for _s in K.STATUS_ORDER:
        _PROFILE.append(f"SELECT '{_f}' AS feature, '{_s}' AS status, "
                        f"{srhe(f'AVG(CASE WHEN status = {chr(39)}{_s}{chr(39)} THEN {_f} END) / AVG({_f})', 9)} AS ratio FROM sub")


@query("e12_status_profile", with_ctes("sub") + " UNION ALL ".join(_PROFILE))
def e12(spark, sf):
    return D.status_profile(fx.sub(spark, sf))


@query("e13_revenue_tree", with_ctes("sub") + f"""
SELECT subscription_type, status, CAST(GROUPING(subscription_type, status) AS INT) AS level, {MONEY} AS revenue_mrr
FROM sub GROUP BY ROLLUP (subscription_type, status)""")
def e13(spark, sf):
    return D.revenue_tree(fx.sub(spark, sf))


@query("e14_plan_mrr", with_ctes("sub") + f"SELECT subscription_type, {MONEY} AS revenue_mrr FROM sub GROUP BY subscription_type")
def e14(spark, sf):
    return D.plan_mrr(fx.sub(spark, sf))


@query("e15_revenue_waterfall", with_ctes("sub", extra=[f"a AS (SELECT {MONEY} AS total, COALESCE({LOST}, 0.0) AS lost FROM sub)"]) + """
SELECT 1 AS step, 'Total MRR' AS label, total AS amount FROM a
UNION ALL SELECT 2, 'Lost to churn', -lost FROM a
UNION ALL SELECT 3, 'Retained MRR', total - lost FROM a""")
def e15(spark, sf):
    return D.revenue_waterfall(fx.sub(spark, sf))


PRIORITY_E16_SQL = with_ctes("sub") + f"""
SELECT CAST(subscription_type AS VARCHAR) AS segment, {PRIORITY} FROM sub GROUP BY subscription_type"""


@query("e16_priority_table", PRIORITY_E16_SQL)
def e16(spark, sf):
    return D.priority_table(fx.sub(spark, sf), "subscription_type")


_ALL = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, {PRIORITY} FROM sub GROUP BY {d}"
    for d in K.PRIORITY_DIMS)


@query("e17_priority_all_dims", with_ctes("sub") + _ALL)
def e17(spark, sf):
    return D.priority_all(fx.sub(spark, sf))


@query("e18_top_priority", with_ctes("sub", extra=[f"p AS ({_ALL})"]) + """
SELECT dimension, segment, subscribers, churn_rate, arr_at_risk FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY arr_at_risk DESC, segment) AS rn FROM p) t WHERE rn = 1""")
def e18(spark, sf):
    return D.top_priority(D.priority_all(fx.sub(spark, sf)))


@query("e19_risk_rank", with_ctes("sub") + f"""
SELECT segment, subscribers, churn_rate, arr_at_risk,
       SUM(churners) OVER () / SUM(subscribers) OVER () * 100.0 AS overall_churn_pct,
       CAST(ROW_NUMBER() OVER (ORDER BY arr_at_risk DESC, segment) AS INT) AS rank FROM (
  SELECT CAST(subscription_type AS VARCHAR) AS segment, {PRIORITY}, SUM(churned) AS churners
  FROM sub GROUP BY subscription_type) t""")
def e19(spark, sf):
    return D.risk_rank(fx.sub(spark, sf))


@query("e20_segment_status_counts", with_ctes("sub") + """
SELECT engagement_segment, status, COUNT(*) AS count FROM sub GROUP BY engagement_segment, status""")
def e20(spark, sf):
    return D.segment_status(fx.sub(spark, sf))


@query("e21_engagement_scatter", with_ctes("sub") + """
SELECT CAST(FLOOR(watch_hours / 50.0) * 50.0 AS DOUBLE) AS hours_bin,
       CAST(FLOOR(last_login_days / 30.0) * 30.0 AS DOUBLE) AS days_bin, status, COUNT(*) AS count
FROM sub GROUP BY 1, 2, 3""")
def e21(spark, sf):
    return D.engagement_grid(fx.sub(spark, sf))


# --- L (descriptive) ------------------------------------------------------------

@query("l1_dim_plan", with_ctes("sub") + """
SELECT subscription_type, MIN(monthly_fee) AS monthly_fee, COUNT(DISTINCT monthly_fee) AS n_fees
FROM sub GROUP BY subscription_type""")
def l1(spark, sf):
    return D.dim_plan(fx.sub(spark, sf))


_LOOKUP = ["region", "device", "favorite_genre"]


@query("l2_dim_lookups", with_ctes("sub") + " UNION ALL ".join(
    f"SELECT '{c}' AS column, value, CAST(DENSE_RANK() OVER (ORDER BY value) AS INT) AS key "
    f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM sub) t{i}" for i, c in enumerate(_LOOKUP)))
def l2(spark, sf):
    return D.dim_lookup(fx.sub(spark, sf), _LOOKUP)


@query("l3_churn_by_engagement", with_ctes("sub") + """
SELECT subscription_type, region, engagement_segment,
       CAST(GROUPING(subscription_type, region, engagement_segment) AS INT) AS level,
       COUNT(*) AS subscribers, AVG(churned) AS churn_rate
FROM sub GROUP BY CUBE (subscription_type, region, engagement_segment)""")
def l3(spark, sf):
    return D.churn_cube(fx.sub(spark, sf))


DOMAINS = {"gender": ["Male", "Female", "Other"], "subscription_type": ["Basic", "Standard", "Premium"]}


@query("l7_category_domain_check", with_ctes("raw", extra=CLEAN_CTES) + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM r_clean "
    f"WHERE {c} IS NULL OR {c} NOT IN (" + ", ".join(f"'{v}'" for v in vs) + f") GROUP BY {c}"
    for c, vs in DOMAINS.items()))
def l7(spark, sf):
    return D.domain_check(fx.clean_table(spark, sf), DOMAINS)


_RAW_COLS = fx.RAW_COLUMNS


@query("l8_missing_report", with_ctes("raw", extra=[
    "t AS (SELECT ingest_seq, customer_id, " + ", ".join(
        f"{sql_num(c)} AS {c}" if c in K.NUMERIC_COLS else c for c in _RAW_COLS[2:]) + " FROM raw)"]) + " UNION ALL ".join(
    f"SELECT '{c}' AS column, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing FROM t" for c in _RAW_COLS))
def l8(spark, sf):
    return D.missing_report(cleaning.coerce_numeric(fx.raw_table(spark, sf)))
