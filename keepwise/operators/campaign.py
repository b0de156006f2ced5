"""Scored-table aggregation F1-F5, campaign planning K7-K10, L4-L6.

The what-if grid scans the scored table once: a per-tier aggregate (three
rows) is expanded into its scenarios with ``explode(sequence(..))`` — no join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions.literals import literal_table
from keepwise.functions import columns as C
from keepwise.functions.numeric import round_half_even

D6 = 6   # sums of non-exact doubles are reported rounded (order of addition varies)
D9 = 9


def _r6(c: Column) -> Column:
    return round_half_even(c, D6)


def risk_kpis(scored: DataFrame, save_rate: float = K.DEFAULT_SAVE_RATE) -> DataFrame:
    """mean probability %, high-risk count, revenue at risk, opportunity."""
    high = F.col("risk_tier") == "High"
    return scored.agg(
        round_half_even(F.avg("churn_probability") * F.lit(100.0), D9).alias("mean_prob_pct"),
        F.count_if(high).alias("high_risk"),
        _r6(F.sum("revenue_at_risk")).alias("revenue_at_risk"),
        _r6(F.coalesce(F.sum(F.when(high, F.col("revenue_at_risk"))), F.lit(0.0)) * F.lit(save_rate)).alias("opportunity"),
    )


def _tiers(scored: DataFrame) -> DataFrame:
    return literal_table(scored.sparkSession, [(t, i) for i, t in enumerate(K.RISK_ORDER)], "risk_tier string, ordinal int")


def tier_distribution(scored: DataFrame) -> DataFrame:
    """count per tier over the domain Low, Medium, High; absent = 0."""
    dom = _tiers(scored)
    counts = scored.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("count"))
    return dom.join(counts, "risk_tier", "left").select(
        "risk_tier", "ordinal", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )


def tier_summary(scored: DataFrame) -> DataFrame:
    """customers and revenue at risk per tier and in total."""
    return scored.rollup("risk_tier").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("customers"),
        _r6(F.sum("revenue_at_risk")).alias("revenue_at_risk"),
    )


def risk_by_plan(scored: DataFrame) -> DataFrame:
    """revenue at risk per plan."""
    return scored.groupBy("subscription_type").agg(_r6(F.sum("revenue_at_risk")).alias("revenue_at_risk"))


def score_summary(scored: DataFrame) -> DataFrame:
    """rows scored, mean probability, High count, revenue at risk."""
    return scored.agg(
        F.count(F.lit(1)).alias("rows_scored"),
        round_half_even(F.avg("churn_probability"), D9).alias("mean_probability"),
        F.count_if(F.col("risk_tier") == "High").alias("high_risk"),
        _r6(F.sum("revenue_at_risk")).alias("revenue_at_risk"),
    )


# --- campaign ---------------------------------------------------------------------

def _tier_totals(scored: DataFrame) -> DataFrame:
    """Per tier of the fixed three: Σp, Σ revenue at risk, Σ fee, count (zeros for
    a tier nobody is in); plus the overall Σp and N as window totals."""
    from pyspark.sql import Window

    per = scored.groupBy("risk_tier").agg(
        F.sum("churn_probability").alias("sum_p"),
        F.sum("revenue_at_risk").alias("sum_rar"),
        F.sum(C.money("monthly_fee")).cast("double").alias("sum_fee"),
        F.count(F.lit(1)).alias("n"),
    )
    every = Window.partitionBy()
    per = _tiers(scored).select("risk_tier").join(per, "risk_tier", "left").select(
        "risk_tier", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sum_p", "sum_rar", "sum_fee")], F.coalesce("n", F.lit(0)).alias("n"))
    return per.select(
        "*", F.sum("sum_p").over(every).alias("all_p"), F.sum("n").over(every).alias("all_n"),
    )


def _scenario(save: Column, discount: Column) -> list[Column]:
    saved = F.col("sum_p") * save
    retained = F.col("sum_rar") * save
    cost = discount * F.col("sum_fee") * F.lit(float(K.REVENUE_MONTHS))
    return [
        _r6(F.col("sum_p")).alias("expected_churners"),
        _r6(F.col("sum_rar")).alias("baseline_rar"),
        _r6(saved).alias("customers_saved"),
        _r6(retained).alias("revenue_retained"),
        _r6(cost).alias("campaign_cost"),
        _r6(retained - cost).alias("net_benefit"),
        round_half_even((F.col("all_p") - saved) / F.nullif("all_n", F.lit(0)), D9).alias("new_churn_rate"),
        round_half_even(F.col("all_p") / F.nullif("all_n", F.lit(0)), D9).alias("base_churn_rate"),
    ]


def campaign(scored: DataFrame, tier: str = "High", save_rate: float = K.DEFAULT_SAVE_RATE,
             discount: float = 0.20) -> DataFrame:
    """K7: what-if for one tier, save rate and discount."""
    t = _tier_totals(scored).where(F.col("risk_tier") == tier)
    return t.select("risk_tier", F.lit(save_rate).alias("save_rate"), F.lit(discount).alias("discount"),
                    *_scenario(F.lit(save_rate), F.lit(discount)))


def campaign_grid(scored: DataFrame) -> DataFrame:
    """K8: every control setting: 3 tiers x 21 save rates x 11 discounts."""
    t = _tier_totals(scored)
    grid = t.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(K.SAVE_RATE_STEPS - 1)))) \
            .withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(K.DISCOUNT_STEPS - 1))))
    save = F.col("__s") * F.lit(5) / F.lit(100.0)
    disc = F.col("__d") * F.lit(5) / F.lit(100.0)
    return grid.select("risk_tier", save.alias("save_rate"), disc.alias("discount"), *_scenario(save, disc))


def break_even(grid: DataFrame) -> DataFrame:
    """K9: per tier and discount, the smallest save rate with net benefit >= 0."""
    return grid.groupBy("risk_tier", "discount").agg(
        F.min(F.when(F.col("net_benefit") >= 0, F.col("save_rate"))).alias("break_even_save_rate")
    )


def playbook(scored: DataFrame) -> DataFrame:
    """Tier, action, customers, revenue at risk; zeros for a tier nobody is in."""
    per = scored.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("customers"), _r6(F.sum("revenue_at_risk")).alias("revenue_at_risk"))
    return _tiers(scored).select("risk_tier").join(per, "risk_tier", "left").select(
        "risk_tier", C.recommended_action().alias("recommended_action"),
        F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"), F.coalesce("revenue_at_risk", F.lit(0.0)).alias("revenue_at_risk"))


# --- design promises ----------------------------------------------------------------

def reliability(scored: DataFrame, bins: int = 10, score: str = "churn_probability", label: str = K.TARGET) -> DataFrame:
    """L4: per probability bin: mean score, observed churn rate, count."""
    b = F.least(F.floor(F.col(score) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(
        round_half_even(F.avg(score), D9).alias("mean_score"),
        F.avg(label).alias("observed_rate"),
        F.count(F.lit(1)).alias("count"),
    )


def monthly_revenue_at_risk(scored: DataFrame) -> DataFrame:
    """Monthly variant p * fee."""
    return scored.select(K.ID_COL, C.revenue_at_risk(months=1).alias("monthly_revenue_at_risk"))
