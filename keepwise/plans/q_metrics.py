"""Registered queries J1-J8 (metrics), G1-G4, G6 (splits, preprocessing) and L5."""
from __future__ import annotations

from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions.numeric import round_half_even, sql_round_half_even as srhe
from keepwise.operators import metrics as M, splits as S
from keepwise.plans import fixtures as fx
from keepwise.plans.oracle_ctes import with_ctes
from keepwise.plans.registry import query


def r9(x: str) -> str:
    return srhe(x, 9)


def metric_ctes(src: str, score: str, label: str, hit: str, prefix: str = "m", part: str | None = None) -> list[str]:
    """DuckDB CTEs computing the seven metrics of (score, label) in ``src``."""
    pc = f"{part}, " if part else ""
    pby = f"PARTITION BY {part} " if part else ""
    gby = f"GROUP BY {part}" if part else ""
    return [
        f"""{prefix}_g AS (SELECT {pc}{score} AS score, SUM({label}) AS pos, SUM(1 - {label}) AS neg,
  SUM({label} * ({hit})) AS pos_hit, SUM((1 - {label}) * ({hit})) AS neg_hit FROM {src} GROUP BY {pc}{score})""",
        f"""{prefix}_r AS (SELECT *, SUM(pos) OVER ({pby}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
  SUM(neg) OVER ({pby}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM {prefix}_g)""",
        f"""{prefix}_a AS (SELECT {pc}SUM(pos) AS P, SUM(neg) AS N, SUM(pos * tp / (tp + fp)) AS ap_sum,
  SUM(neg * (tp - pos / 2.0::DOUBLE)) AS roc_sum, SUM(pos_hit) AS tp_t, SUM(neg_hit) AS fp_t,
  SUM(pos * pow(score - 1.0::DOUBLE, 2) + neg * pow(score, 2)) AS sq_sum FROM {prefix}_r {gby})""",
        f"""{prefix} AS (SELECT {pc}{r9('CASE WHEN P > 0 THEN ap_sum / P ELSE 0.0::DOUBLE END')} AS pr_auc,
  {r9('CASE WHEN P > 0 AND N > 0 THEN roc_sum / (P * N) END')} AS roc_auc,
  COALESCE(2.0::DOUBLE * tp_t / NULLIF(2.0::DOUBLE * tp_t + fp_t + (P - tp_t), 0), 0.0::DOUBLE) AS f1,
  COALESCE(CAST(tp_t AS DOUBLE) / NULLIF(CAST(tp_t + fp_t AS DOUBLE), 0), 0.0::DOUBLE) AS precision,
  COALESCE(CAST(tp_t AS DOUBLE) / NULLIF(CAST(P AS DOUBLE), 0), 0.0::DOUBLE) AS recall,
  (tp_t + (N - fp_t)) / (P + N) AS accuracy, {r9('sq_sum / (P + N)')} AS brier FROM {prefix}_a)""",
    ]


SCORED_METRICS = metric_ctes("scored", "churn_probability", "churned", "CASE WHEN churn_probability >= 0.5 THEN 1 ELSE 0 END")


def _scored(spark, sf):
    return fx.scored_fx(spark, sf)


@query("j1_pr_auc", with_ctes("scored", extra=SCORED_METRICS) + "SELECT pr_auc FROM m")
def j1(spark, sf):
    return M.average_precision(_scored(spark, sf))


@query("j2_roc_auc", with_ctes("scored", extra=SCORED_METRICS) + "SELECT roc_auc FROM m")
def j2(spark, sf):
    return M.roc_auc(_scored(spark, sf))


@query("j3_threshold_metrics", with_ctes("scored") + """
SELECT tp, fp, fn, tn,
       COALESCE(2.0::DOUBLE * tp / NULLIF(2.0::DOUBLE * tp + fp + fn, 0), 0.0::DOUBLE) AS f1,
       COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0::DOUBLE) AS precision,
       COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0::DOUBLE) AS recall,
       (tp + tn) / (tp + fp + fn + tn) AS accuracy
FROM (SELECT COUNT(*) FILTER (WHERE churn_probability >= 0.5 AND churned = 1) AS tp,
             COUNT(*) FILTER (WHERE churn_probability >= 0.5 AND churned = 0) AS fp,
             COUNT(*) FILTER (WHERE churn_probability < 0.5 AND churned = 1) AS fn,
             COUNT(*) FILTER (WHERE churn_probability < 0.5 AND churned = 0) AS tn FROM scored) c""")
def j3(spark, sf):
    return M.threshold_metrics(_scored(spark, sf))


@query("j4_brier", with_ctes("scored") + f"SELECT {r9('AVG(pow(churn_probability - churned, 2))')} AS brier FROM scored")
def j4(spark, sf):
    return M.brier(_scored(spark, sf))


@query("j5_score_metrics", with_ctes("scored", extra=SCORED_METRICS) + "SELECT * FROM m")
def j5(spark, sf):
    return M.score_metrics(_scored(spark, sf))


# --- split (G1) as DuckDB text, shared by the train/test based oracles -------------

SPLIT_CTES = [
    "sp_cnt AS (SELECT churned AS c, COUNT(*) AS n FROM sub GROUP BY churned)",
    "sp_tot AS (SELECT SUM(n) AS nn, SUM(n) - CEIL(0.2 * SUM(n)) AS n_train FROM sp_cnt)",
    "sp_alloc AS (SELECT c, n, CAST(n AS DOUBLE) / nn * n_train AS cont, n_train FROM sp_cnt, sp_tot)",
    """sp_rank AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cont - FLOOR(cont) DESC, c) AS rr,
       n_train - SUM(FLOOR(cont)) OVER () AS need FROM sp_alloc)""",
    "sp_t AS (SELECT c, n - (FLOOR(cont) + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS t FROM sp_rank)",
    """split AS (SELECT s.*, CASE WHEN ROW_NUMBER() OVER (PARTITION BY s.churned
         ORDER BY md5(CAST(s.customer_id AS VARCHAR) || ':42'), s.customer_id) <= sp_t.t
         THEN 'test' ELSE 'train' END AS split FROM sub s JOIN sp_t ON s.churned = sp_t.c)""",
    "train AS (SELECT * EXCLUDE (split) FROM split WHERE split = 'train')",
    "test AS (SELECT * EXCLUDE (split) FROM split WHERE split = 'test')",
]


def _split(spark, sf):
    return fx.split(spark, sf)


def _train_test(spark, sf):
    sp = _split(spark, sf)
    return sp.where("split = 'train'").drop("split"), sp.where("split = 'test'").drop("split")


@query("g1_stratified_split", with_ctes("sub", extra=SPLIT_CTES) + "SELECT customer_id, churned, split FROM split")
def g1(spark, sf):
    return _split(spark, sf).select(K.ID_COL, K.TARGET, "split")


@query("g2_stratified_folds", with_ctes("sub", extra=SPLIT_CTES) + """
SELECT customer_id, churned, CAST((ROW_NUMBER() OVER (PARTITION BY churned
       ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42:fold'), customer_id) - 1) % 5 AS INT) AS fold FROM train""")
def g2(spark, sf):
    train, _ = _train_test(spark, sf)
    return S.with_folds(train).select(K.ID_COL, K.TARGET, "fold")


_NUM = K.NUMERIC_FEATURES


@query("g3_standard_scale", with_ctes("sub", extra=SPLIT_CTES + [
    "st AS (SELECT " + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in _NUM) + " FROM train)"]) +
    "SELECT customer_id, " + ", ".join(
        srhe(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0::DOUBLE ELSE s_{c} END", 6) + f" AS {c}"
        for c in _NUM) + " FROM sub CROSS JOIN st")
def g3(spark, sf):
    train, _ = _train_test(spark, sf)
    stats = S.fit_scaler(train, _NUM)
    scaled = S.scale(fx.sub(spark, sf), stats)
    return scaled.select(K.ID_COL, *[round_half_even(F.col(c), 6).alias(c) for c in _NUM])


_CAT = K.CATEGORICAL_FEATURES


def _long_sql(src: str, with_key: bool) -> str:
    k = "customer_id, " if with_key else ""
    return " UNION ALL ".join(f"SELECT {k}'{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {src}" for c in _CAT)


@query("g4_one_hot", with_ctes("sub", extra=SPLIT_CTES + [
    f"seen AS (SELECT col, value, ROW_NUMBER() OVER (PARTITION BY col ORDER BY value) - 1 AS slot FROM (SELECT DISTINCT * FROM ({_long_sql('train', False)}) x) y)",
    f"cells AS ({_long_sql('sub', True)})"]) + """
SELECT c.customer_id, c.col || '_' || c.value AS feature, CAST(s.slot AS INT) AS slot, 1.0::DOUBLE AS value
FROM cells c JOIN seen s ON s.col = c.col AND s.value = c.value""")
def g4(spark, sf):
    train, _ = _train_test(spark, sf)
    return S.one_hot(train, fx.sub(spark, sf), _CAT)


@query("g6_class_weights", with_ctes("sub", extra=SPLIT_CTES) + """
SELECT customer_id, churned, (SELECT COUNT(*) FROM train) / (2 * COUNT(*) OVER (PARTITION BY churned)) AS class_weight
FROM train""")
def g6(spark, sf):
    train, _ = _train_test(spark, sf)
    return S.with_class_weight(train).select(K.ID_COL, K.TARGET, "class_weight")


# --- baselines ------------------------------------------------------------------------

@query("j6_majority_baseline", with_ctes("sub", extra=SPLIT_CTES + [
    "mc AS (SELECT CAST(round_even(AVG(churned), 0) AS INT) AS k FROM train)"]) + """
SELECT 'Majority class' AS name,
       SUM(CASE WHEN churned = k THEN 1 ELSE 0 END) / COUNT(*) AS accuracy,
       COALESCE(2.0::DOUBLE * SUM(CASE WHEN k = 1 AND churned = 1 THEN 1 ELSE 0 END)
         / NULLIF(2.0::DOUBLE * SUM(CASE WHEN k = 1 AND churned = 1 THEN 1 ELSE 0 END)
                  + SUM(CASE WHEN k = 1 AND churned = 0 THEN 1 ELSE 0 END)
                  + SUM(CASE WHEN k = 0 AND churned = 1 THEN 1 ELSE 0 END), 0), 0.0::DOUBLE) AS f1,
       SUM(churned) / COUNT(*) AS pr_auc, 0.5::DOUBLE AS roc_auc
FROM test CROSS JOIN mc""")
def j6(spark, sf):
    train, test = _train_test(spark, sf)
    return M.majority_baseline(train, test)


_PROBS = ", ".join(repr(p) for p in M.INACTIVITY_PROBS)
_CAND_CTES = [
    f"qs AS (SELECT UNNEST(quantile_cont(last_login_days, [{_PROBS}]::DOUBLE[])) AS cut, UNNEST(range(0, 17)) AS position FROM train)",
    """cand AS (SELECT CAST(qs.position AS INT) AS position, qs.cut,
       COALESCE(2.0::DOUBLE * SUM(CASE WHEN t.last_login_days >= qs.cut AND t.churned = 1 THEN 1 ELSE 0 END)
         / NULLIF(2.0::DOUBLE * SUM(CASE WHEN t.last_login_days >= qs.cut AND t.churned = 1 THEN 1 ELSE 0 END)
                  + SUM(CASE WHEN t.last_login_days >= qs.cut AND t.churned = 0 THEN 1 ELSE 0 END)
                  + SUM(CASE WHEN t.last_login_days < qs.cut AND t.churned = 1 THEN 1 ELSE 0 END), 0), 0.0::DOUBLE) AS f1
     FROM qs CROSS JOIN train t GROUP BY qs.position, qs.cut)""",
    """cand2 AS (SELECT *, position = MIN(CASE WHEN f1 = MAX(f1) OVER () THEN position END) OVER () AS is_best FROM cand)""",
]


@query("j7_inactivity_threshold", with_ctes("sub", extra=SPLIT_CTES + _CAND_CTES[:2]) + """
SELECT position, cut, f1, position = (SELECT MIN(position) FROM cand WHERE f1 = (SELECT MAX(f1) FROM cand)) AS is_best
FROM cand""")
def j7(spark, sf):
    train, _ = _train_test(spark, sf)
    return M.inactivity_candidates(train)


_J8 = _CAND_CTES[:2] + [
    "best AS (SELECT cut FROM cand WHERE position = (SELECT MIN(position) FROM cand WHERE f1 = (SELECT MAX(f1) FROM cand)))",
    "den AS (SELECT GREATEST(MAX(last_login_days), 1.0::DOUBLE) AS d FROM test)",
    """ib AS (SELECT churned, GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, last_login_days / d)) AS p,
       CASE WHEN last_login_days >= best.cut THEN 1 ELSE 0 END AS hit FROM test CROSS JOIN den CROSS JOIN best)""",
] + metric_ctes("ib", "p", "churned", "hit", prefix="im")


@query("j8_inactivity_baseline", with_ctes("sub", extra=SPLIT_CTES + _J8) + """
SELECT 'Inactive >= ' || CAST(CAST(round_even(best.cut, 0) AS BIGINT) AS VARCHAR) || ' days' AS name,
       accuracy, f1, pr_auc, roc_auc FROM im CROSS JOIN best""")
def j8(spark, sf):
    train, test = _train_test(spark, sf)
    return M.inactivity_baseline(train, test)


# --- L5 ----------------------------------------------------------------------------------

_FOLDS = """fx AS (SELECT s.*, CAST((ROW_NUMBER() OVER (PARTITION BY churned
       ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42:fold'), customer_id) - 1) % 5 AS INT) AS fold FROM scored s)"""


@query("l5_cv_mean_std", with_ctes("scored", extra=[_FOLDS] + metric_ctes(
    "fx", "churn_probability", "churned", "CASE WHEN churn_probability >= 0.5 THEN 1 ELSE 0 END", prefix="fm", part="fold")
    + ["fl AS (UNPIVOT fm ON pr_auc, roc_auc, f1, precision, recall, accuracy, brier INTO NAME metric VALUE value)"]) + f"""
SELECT metric, {srhe('AVG(value)', 6)} AS mean, {srhe('STDDEV_POP(value)', 6)} AS std FROM fl GROUP BY metric""")
def l5(spark, sf):
    from keepwise.operators.evaluation import fold_metrics
    return fold_metrics(S.with_folds(_scored(spark, sf)))
