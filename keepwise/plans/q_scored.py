"""Registered queries F1-F5, K2-K10 and L4-L6 over the scored fixture."""
from __future__ import annotations

from keepwise import constants as K
from keepwise.functions.numeric import sql_round_half_even as srhe
from keepwise.operators import campaign as CP, scoring
from keepwise.plans import fixtures as fx
from keepwise.plans.oracle_ctes import with_ctes
from keepwise.plans.registry import query


def r6(x: str) -> str:
    return srhe(x, 6)


def r9(x: str) -> str:
    return srhe(x, 9)


# --- F ------------------------------------------------------------------------

@query("f1_risk_kpis", with_ctes("scored") + f"""
SELECT {r9('AVG(churn_probability) * 100.0')} AS mean_prob_pct,
       COUNT(*) FILTER (WHERE risk_tier = 'High') AS high_risk,
       {r6('SUM(revenue_at_risk)')} AS revenue_at_risk,
       {r6("COALESCE(SUM(CASE WHEN risk_tier = 'High' THEN revenue_at_risk END), 0.0) * 0.3::DOUBLE")} AS opportunity
FROM scored""")
def f1(spark, sf):
    return CP.risk_kpis(fx.scored_fx(spark, sf))


@query("f2_tier_distribution", with_ctes("scored") + """
SELECT d.risk_tier, CAST(d.ordinal AS INT) AS ordinal, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM (SELECT * FROM (VALUES ('Low', 0), ('Medium', 1), ('High', 2)) t(risk_tier, ordinal)) d
LEFT JOIN (SELECT risk_tier, COUNT(*) AS n FROM scored GROUP BY risk_tier) c ON c.risk_tier = d.risk_tier""")
def f2(spark, sf):
    return CP.tier_distribution(fx.scored_fx(spark, sf))


@query("f3_tier_summary", with_ctes("scored") + f"""
SELECT risk_tier, CAST(GROUPING(risk_tier) AS INT) AS level, COUNT(*) AS customers,
       {r6('SUM(revenue_at_risk)')} AS revenue_at_risk FROM scored GROUP BY ROLLUP (risk_tier)""")
def f3(spark, sf):
    return CP.tier_summary(fx.scored_fx(spark, sf))


@query("f4_risk_by_plan", with_ctes("scored") + f"""
SELECT subscription_type, {r6('SUM(revenue_at_risk)')} AS revenue_at_risk FROM scored GROUP BY subscription_type""")
def f4(spark, sf):
    return CP.risk_by_plan(fx.scored_fx(spark, sf))


@query("f5_score_summary", with_ctes("scored") + f"""
SELECT COUNT(*) AS rows_scored, {r9('AVG(churn_probability)')} AS mean_probability,
       COUNT(*) FILTER (WHERE risk_tier = 'High') AS high_risk, {r6('SUM(revenue_at_risk)')} AS revenue_at_risk
FROM scored""")
def f5(spark, sf):
    return CP.score_summary(fx.scored_fx(spark, sf))


# --- K ------------------------------------------------------------------------

def _scored_input(spark, sf):
    """``sub`` plus the exact stand-in probability: what a model would hand over."""
    return fx.stand_in_score(fx.sub(spark, sf))


@query("k2_risk_tier", with_ctes("scored") + "SELECT customer_id, churn_probability, risk_tier FROM scored")
def k2(spark, sf):
    return scoring.with_risk_tier(_scored_input(spark, sf)).select(K.ID_COL, "churn_probability", "risk_tier")


@query("k3_revenue_at_risk", with_ctes("scored") + "SELECT customer_id, revenue_at_risk FROM scored")
def k3(spark, sf):
    return scoring.with_revenue_at_risk(_scored_input(spark, sf)).select(K.ID_COL, "revenue_at_risk")


@query("k4_recommended_action", with_ctes("scored") + "SELECT customer_id, risk_tier, recommended_action FROM scored")
def k4(spark, sf):
    df = scoring.with_action(scoring.with_risk_tier(_scored_input(spark, sf)))
    return df.select(K.ID_COL, "risk_tier", "recommended_action")


@query("k5_key_factor", with_ctes("scored") + "SELECT customer_id, key_factor FROM scored")
def k5(spark, sf):
    return scoring.with_key_factor(_scored_input(spark, sf)).select(K.ID_COL, "key_factor")


@query("k6_scored_table", with_ctes("scored") + "SELECT * FROM scored")
def k6(spark, sf):
    return scoring.build_scored(_scored_input(spark, sf))


_TIER_TOTALS = """tt AS (
  SELECT d.risk_tier, COALESCE(SUM(churn_probability), 0.0::DOUBLE) AS sum_p, COALESCE(SUM(revenue_at_risk), 0.0::DOUBLE) AS sum_rar,
         COALESCE(CAST(SUM(CAST(monthly_fee AS DECIMAL(18,2))) AS DOUBLE), 0.0::DOUBLE) AS sum_fee, COUNT(s.risk_tier) AS n
  FROM (VALUES ('Low'), ('Medium'), ('High')) d(risk_tier) LEFT JOIN scored s ON s.risk_tier = d.risk_tier GROUP BY d.risk_tier
), tt2 AS (SELECT *, SUM(sum_p) OVER () AS all_p, SUM(n) OVER () AS all_n FROM tt)"""


def _scenario_sql(save: str, disc: str) -> str:
    return f"""{r6('sum_p')} AS expected_churners, {r6('sum_rar')} AS baseline_rar,
       {r6(f'sum_p * {save}')} AS customers_saved, {r6(f'sum_rar * {save}')} AS revenue_retained,
       {r6(f'{disc} * sum_fee * 12.0::DOUBLE')} AS campaign_cost,
       {r6(f'sum_rar * {save} - {disc} * sum_fee * 12.0::DOUBLE')} AS net_benefit,
       {r9(f'(all_p - sum_p * {save}) / all_n')} AS new_churn_rate, {r9('all_p / all_n')} AS base_churn_rate"""


@query("k7_campaign_what_if", with_ctes("scored", extra=[_TIER_TOTALS]) + f"""
SELECT risk_tier, 0.3::DOUBLE AS save_rate, 0.2::DOUBLE AS discount, {_scenario_sql('0.3::DOUBLE', '0.2::DOUBLE')}
FROM tt2 WHERE risk_tier = 'High'""")
def k7(spark, sf):
    return CP.campaign(fx.scored_fx(spark, sf), "High", 0.30, 0.20)


_GRID_SQL = f"""grid AS (
SELECT risk_tier, s * 5 / 100.0::DOUBLE AS save_rate, d * 5 / 100.0::DOUBLE AS discount,
       {_scenario_sql('(s * 5 / 100.0::DOUBLE)', '(d * 5 / 100.0::DOUBLE)')}
FROM tt2, range(0, 21) r1(s), range(0, 11) r2(d))"""


@query("k8_campaign_grid", with_ctes("scored", extra=[_TIER_TOTALS, _GRID_SQL]) + "SELECT * FROM grid")
def k8(spark, sf):
    return CP.campaign_grid(fx.scored_fx(spark, sf))


@query("k9_break_even", with_ctes("scored", extra=[_TIER_TOTALS, _GRID_SQL]) + """
SELECT risk_tier, discount, MIN(CASE WHEN net_benefit >= 0 THEN save_rate END) AS break_even_save_rate
FROM grid GROUP BY risk_tier, discount""")
def k9(spark, sf):
    return CP.break_even(CP.campaign_grid(fx.scored_fx(spark, sf)))


@query("k10_playbook", with_ctes("scored") + f"""
SELECT risk_tier, CASE risk_tier WHEN 'High' THEN 'Offer targeted discount / personalized content'
                  WHEN 'Medium' THEN 'Send re-engagement campaign'
                  ELSE 'Maintain engagement / loyalty rewards' END AS recommended_action,
       COUNT(customer_id) AS customers, COALESCE({r6('SUM(revenue_at_risk)')}, 0.0::DOUBLE) AS revenue_at_risk
FROM (SELECT d.risk_tier, s.customer_id, s.revenue_at_risk FROM (VALUES ('Low'), ('Medium'), ('High')) d(risk_tier)
      LEFT JOIN scored s ON s.risk_tier = d.risk_tier) GROUP BY risk_tier""")
def k10(spark, sf):
    return CP.playbook(fx.scored_fx(spark, sf))


# --- L ------------------------------------------------------------------------

@query("l4_reliability_curve", with_ctes("scored") + f"""
SELECT CAST(LEAST(FLOOR(churn_probability * 10), 9) AS INT) AS bin, {r9('AVG(churn_probability)')} AS mean_score,
       AVG(churned) AS observed_rate, COUNT(*) AS count FROM scored GROUP BY 1""")
def l4(spark, sf):
    return CP.reliability(fx.scored_fx(spark, sf))


@query("l6_monthly_revenue_at_risk", with_ctes("scored") + """
SELECT customer_id, churn_probability * monthly_fee * CAST(1 AS DOUBLE) AS monthly_revenue_at_risk FROM scored""")
def l6(spark, sf):
    return CP.monthly_revenue_at_risk(fx.scored_fx(spark, sf))

