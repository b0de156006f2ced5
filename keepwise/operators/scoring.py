"""Scoring K1-K6: probability -> tier, revenue at risk, action, key factor."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions import columns as C
from keepwise.functions.quantiles import medians

SCORED_COLUMNS = [
    K.ID_COL, "churn_probability", "risk_tier", "monthly_fee", "revenue_at_risk",
    "recommended_action", "key_factor", "subscription_type", "engagement_segment",
    "region", "age", K.TARGET,
]


def with_risk_tier(df: DataFrame, p: str = "churn_probability") -> DataFrame:
    """K2: p >= 0.70 High, p <= 0.40 Low, else Medium."""
    return df.withColumn("risk_tier", C.risk_tier(p))


def with_revenue_at_risk(df: DataFrame, months: int = K.REVENUE_MONTHS, name: str = "revenue_at_risk") -> DataFrame:
    """K3 (and L6 with ``months=1``): p * fee * months."""
    return df.withColumn(name, C.revenue_at_risk(months=months))


def with_action(df: DataFrame) -> DataFrame:
    """K4: tier -> action text (a literal map, no join needed)."""
    return df.withColumn("recommended_action", C.recommended_action())


def key_factor_medians(df: DataFrame) -> tuple[float, float, float]:
    m = medians(df, ["last_login_days", "avg_watch_time_per_day", "monthly_fee"])
    return m["last_login_days"], m["avg_watch_time_per_day"], m["monthly_fee"]


def with_key_factor(df: DataFrame, meds: tuple[float, float, float] | None = None) -> DataFrame:
    """K5: first rule that holds, medians over all scored rows."""
    m_login, m_daily, m_fee = meds or key_factor_medians(df)
    return df.withColumn("key_factor", C.key_factor(m_login, m_daily, m_fee))


def build_scored(df: DataFrame, meds: tuple[float, float, float] | None = None) -> DataFrame:
    """K6: the 12-column scored table in one projection (no positional alignment).

    ``meds`` (login days, daily watch time, fee) default to the medians over
    ``df``; a stream passes the medians of a reference table instead.
    """
    meds = meds or key_factor_medians(df)
    tier = C.risk_tier()
    m_login, m_daily, m_fee = meds
    return df.select(
        K.ID_COL,
        "churn_probability",
        tier.alias("risk_tier"),
        "monthly_fee",
        C.revenue_at_risk().alias("revenue_at_risk"),
        C.recommended_action(tier).alias("recommended_action"),
        C.key_factor(m_login, m_daily, m_fee).alias("key_factor"),
        "subscription_type", "engagement_segment", "region", "age", K.TARGET,
    )
