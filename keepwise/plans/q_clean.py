"""Registered queries B1-B9 (cleaning) and C1-C7 (derived features)."""
from __future__ import annotations

from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions import columns as C
from keepwise.operators import cleaning, features
from keepwise.plans import fixtures as fx
from keepwise.plans.oracle_ctes import with_ctes
from keepwise.plans.registry import query

NUMERIC_RE = C.NUMERIC_TEXT.replace("'", "''")
NUMS = K.NUMERIC_COLS
CATS = K.CATEGORICAL_COLS


def sql_num(col: str) -> str:
    return (f"CASE WHEN regexp_matches({col}, '{NUMERIC_RE}') "
            f"THEN TRY_CAST(regexp_replace({col}, '^\\s+|\\s+$', '', 'g') AS DOUBLE) END")


def sql_cat(col: str) -> str:
    s = f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {col} IS NULL OR {s} IN ('nan', '', 'None') THEN 'Unknown' ELSE {s} END"


def sql_target(col: str) -> str:
    return f"CAST(TRUNC(GREATEST(0.0, LEAST(1.0, COALESCE({sql_num(col)}, 0.0)))) AS INT)"


# typed + deduplicated raw, medians after dedupe, then the rest of the chain
_COERCED = "r_num AS (SELECT ingest_seq, customer_id, " + ", ".join(
    f"{sql_num(c)} AS {c}" for c in NUMS) + ", " + ", ".join(CATS) + ", churned FROM raw)"
_DEDUPED = """r_dd AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ingest_seq) AS rn FROM r_num) t WHERE rn = 1)"""
_MED = "r_med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5::DOUBLE) AS m_{c}" for c in NUMS) + " FROM r_dd)"
_FILLED = "r_fill AS (SELECT ingest_seq, customer_id, " + ", ".join(
    f"COALESCE({c}, m_{c}) AS {c}" for c in NUMS) + ", " + ", ".join(CATS) + ", churned FROM r_dd CROSS JOIN r_med)"
_RANGE = ("age BETWEEN 0 AND 120 AND monthly_fee >= 0 AND watch_hours >= 0 "
          "AND last_login_days >= 0 AND number_of_profiles >= 0")
_CLEAN = ("r_clean AS (SELECT customer_id, age, " + f"{sql_cat('gender')} AS gender, "
          + f"{sql_cat('subscription_type')} AS subscription_type, watch_hours, last_login_days, "
          + f"{sql_cat('region')} AS region, {sql_cat('device')} AS device, monthly_fee, "
          + f"{sql_target('churned')} AS churned, {sql_cat('payment_method')} AS payment_method, "
          + f"number_of_profiles, avg_watch_time_per_day, {sql_cat('favorite_genre')} AS favorite_genre "
          + f"FROM r_fill WHERE {_RANGE})")
CLEAN_CTES = [_COERCED, _DEDUPED, _MED, _FILLED, _CLEAN]


def clean_sql(select: str = "SELECT * FROM r_clean") -> str:
    return with_ctes("raw", extra=CLEAN_CTES) + select


# --- B ------------------------------------------------------------------------

@query("b1_normalize_columns", with_ctes("raw") + "SELECT * FROM raw")
def b1(spark, sf):
    raw = fx.raw_table(spark, sf)
    messy = raw.toDF(*[f"  {c.upper()} " if i % 2 else f"{c.title()}\t" for i, c in enumerate(raw.columns)])
    return cleaning.normalize_columns(messy)


@query("b2_coerce_numeric", with_ctes("raw", extra=[_COERCED]) + "SELECT ingest_seq, customer_id, "
       + ", ".join(NUMS) + " FROM r_num")
def b2(spark, sf):
    return cleaning.coerce_numeric(fx.raw_table(spark, sf)).select("ingest_seq", K.ID_COL, *NUMS)


@query("b3_dedupe_keep_first", with_ctes("raw") + """SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ingest_seq) AS rn FROM raw) t WHERE rn = 1""")
def b3(spark, sf):
    return cleaning.dedupe(fx.raw_table(spark, sf))


@query("b4_impute_median", with_ctes("raw", extra=[_COERCED, _DEDUPED, _MED, _FILLED])
       + "SELECT customer_id, " + ", ".join(NUMS) + " FROM r_fill")
def b4(spark, sf):
    df = cleaning.dedupe(cleaning.coerce_numeric(fx.raw_table(spark, sf)))
    return cleaning.impute_median(df).select(K.ID_COL, *NUMS)


@query("b5_normalize_categories", with_ctes("raw") + "SELECT ingest_seq, customer_id, "
       + ", ".join(f"{sql_cat(c)} AS {c}" for c in CATS) + " FROM raw")
def b5(spark, sf):
    return cleaning.normalize_categories(fx.raw_table(spark, sf)).select("ingest_seq", K.ID_COL, *CATS)


@query("b6_range_filter", with_ctes("raw", extra=[_COERCED, _DEDUPED, _MED, _FILLED])
       + "SELECT customer_id, " + ", ".join(NUMS) + f" FROM r_fill WHERE {_RANGE}")
def b6(spark, sf):
    df = cleaning.impute_median(cleaning.dedupe(cleaning.coerce_numeric(fx.raw_table(spark, sf))))
    return cleaning.range_filter(df).select(K.ID_COL, *NUMS)


@query("b7_normalize_target", with_ctes("raw") + f"SELECT ingest_seq, customer_id, {sql_target('churned')} AS churned FROM raw")
def b7(spark, sf):
    return cleaning.normalize_target(fx.raw_table(spark, sf)).select("ingest_seq", K.ID_COL, K.TARGET)


@query("b8_quality_report", with_ctes("raw", extra=[_COERCED, _DEDUPED, _MED, _FILLED]) + f"""
SELECT (SELECT COUNT(*) FROM raw) AS rows_read,
       (SELECT COUNT(*) FROM raw) - COUNT(*) AS duplicates_dropped,
       COUNT(*) FILTER (WHERE NOT COALESCE({_RANGE}, FALSE)) AS range_dropped,
       COUNT(*) FILTER (WHERE COALESCE({_RANGE}, FALSE)) AS rows_kept,
       AVG(CASE WHEN COALESCE({_RANGE}, FALSE) THEN {sql_target('churned')} END) AS churn_rate
FROM r_fill""")
def b8(spark, sf):
    return cleaning.quality_report(fx.raw_table(spark, sf))


@query("b9_clean_pipeline", clean_sql())
def b9(spark, sf):
    return cleaning.clean(fx.raw_table(spark, sf))


# --- C ------------------------------------------------------------------------

@query("c1_watch_per_profile", with_ctes("snap") + """
SELECT customer_id, watch_hours, number_of_profiles,
       COALESCE(watch_hours / NULLIF(number_of_profiles, 0), watch_hours) AS watch_per_profile FROM snap""")
def c1(spark, sf):
    s = fx.snap_table(spark, sf)
    return features.with_watch_per_profile(s).select(K.ID_COL, "watch_hours", "number_of_profiles", "watch_per_profile")


@query("c2_engagement_segment", with_ctes("snap", extra=["""q AS (
  SELECT quantile_cont(avg_watch_time_per_day, 1.0::DOUBLE/3) AS q1,
         quantile_cont(avg_watch_time_per_day, 2.0::DOUBLE/3) AS q2 FROM snap)"""]) + """
SELECT customer_id, avg_watch_time_per_day,
       CASE WHEN avg_watch_time_per_day IS NULL THEN 'nan'
            WHEN avg_watch_time_per_day <= q1 THEN 'Low'
            WHEN avg_watch_time_per_day <= q2 THEN 'Medium' ELSE 'High' END AS engagement_segment
FROM snap CROSS JOIN q""")
def c2(spark, sf):
    s = fx.snap_table(spark, sf)
    cuts = features.fit_tertiles(s)
    return features.with_engagement(s, cuts).select(K.ID_COL, "avg_watch_time_per_day", "engagement_segment")


@query("c3_recency_bucket", with_ctes("snap") + """
SELECT customer_id, last_login_days,
       CASE WHEN last_login_days > -1 AND last_login_days <= 7 THEN 'Active'
            WHEN last_login_days > 7 AND last_login_days <= 30 THEN 'Lapsing'
            WHEN last_login_days > 30 THEN 'Dormant' ELSE 'nan' END AS recency_bucket FROM snap""")
def c3(spark, sf):
    return features.with_recency(fx.snap_table(spark, sf)).select(K.ID_COL, "last_login_days", "recency_bucket")


@query("c4_age_band", with_ctes("sub") + """
SELECT customer_id, age,
       CASE WHEN age > 0 AND age <= 25 THEN '<25' WHEN age > 25 AND age <= 35 THEN '25-34'
            WHEN age > 35 AND age <= 45 THEN '35-44' WHEN age > 45 AND age <= 55 THEN '45-54'
            WHEN age > 55 AND age <= 200 THEN '55+' END AS age_band FROM sub""")
def c4(spark, sf):
    return features.with_age_band(fx.sub(spark, sf)).select(K.ID_COL, "age", "age_band")


@query("c5_status", with_ctes("sub") + "SELECT customer_id, churned, status FROM sub")
def c5(spark, sf):
    return features.with_status(fx.sub(spark, sf).drop("status")).select(K.ID_COL, K.TARGET, "status")


_FEATS = K.NUMERIC_FEATURES + K.CATEGORICAL_FEATURES


@query("c6_feature_projection", with_ctes("sub") + "SELECT customer_id, " + ", ".join(_FEATS) + ", churned FROM sub")
def c6(spark, sf):
    return features.project_features(fx.sub(spark, sf))


@query("c7_money_format", with_ctes("scored") + """
SELECT customer_id, revenue_at_risk,
       '$' || format('{:,}', CAST(round_even(revenue_at_risk, 0) AS BIGINT)) AS revenue_text FROM scored""")
def c7(spark, sf):
    s = fx.scored_fx(spark, sf)
    return s.select(K.ID_COL, "revenue_at_risk", C.fmt_money("revenue_at_risk").alias("revenue_text"))
