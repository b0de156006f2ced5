"""Registered queries G5, H1-H14 and K1 (Spark ML on the planted-signal fixture).

Model outputs cannot be matched bit for bit by SQL, so most are rows-only
for the driver; the invariants named in SURVEY §2.H are asserted in the tests.
G5, H5 (all but the probabilities' values) and H8 (the min-max formula over
score bins) have exact oracles; H6, H7 and H11 also run on stand-in scores,
whose comparison, selection and delta SQL can state.
All learners are fitted at the reference's sizes. A query fits what it shows:
H1-H4 one learner each (with its folds), H6 the rest; the others go on from
those fits, which one session and data folder share.
"""
from __future__ import annotations

from functools import cached_property, reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions.numeric import round_half_even, sql_round_half_even as srhe
from keepwise.operators import models as H
from keepwise.operators.features import feature_columns
from keepwise.operators.metrics import metrics_long, score_metrics
from keepwise.operators.splits import stratified_split
from keepwise.plans import fixtures as fx
from keepwise.plans.oracle_ctes import with_ctes
from keepwise.plans.q_metrics import SPLIT_CTES, metric_ctes
from keepwise.plans.registry import query
from keepwise.sources import io

LABEL = "label"


class ModelRun:
    """Train/test split of the planted fixture and every fit derived from it."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        planted = fx.planted(spark, sf).drop("base")
        sp = stratified_split(planted, label=LABEL).persist()
        self.train = sp.where("split = 'train'").drop("split").persist()
        self.test = sp.where("split = 'test'").drop("split").persist()
        self.num, self.cat = feature_columns()

        self._fits: dict[str, H.Fits] = {}

    @cached_property
    def folded(self) -> DataFrame:
        return H.with_stored_folds(self.train, label=LABEL)

    def fits(self, name: str) -> H.Fits:
        """The learner's fits, made when first asked for."""
        if name not in self._fits:
            self._fits[name] = H.fit_folds(self.folded, name, self.num, self.cat, label=LABEL)
        return self._fits[name]

    @cached_property
    def metrics(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.fits(n).metrics(self.test) for n in K.MODEL_ORDER]).persist()

    @cached_property
    def best(self) -> str:
        return H.select_best(self.metrics).first()["best_model"]

    @cached_property
    def calibrated(self) -> H.CalibratedModel:
        return H.calibrate(self.fits(self.best))

    @cached_property
    def leakage(self) -> DataFrame:
        return H.leakage_audit(self.train, self.test, self.fits(self.best)).persist()

    @cached_property
    def saved_path(self) -> str:
        path = io.shared_path(self.spark, io.tag(self.sf), "model")
        H.save_model(self.spark, self.calibrated, path)
        return path


_RUNS: dict[tuple, ModelRun] = {}


def run(spark: SparkSession, sf: str) -> ModelRun:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = ModelRun(spark, sf)
    return _RUNS[key]


#: the split of the planted fixture as DuckDB text: that of ``sub``, on the planted label
_SPLIT = [c.replace("churned", LABEL).replace("FROM sub", "FROM planted") for c in SPLIT_CTES]
_NUM, _CAT = feature_columns()


@query("g5_preprocess_pipeline", with_ctes("planted", extra=_SPLIT + [
    "st AS (SELECT " + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_SAMP({c}) AS s_{c}" for c in _NUM) + " FROM train)",
    "seen AS (SELECT " + " + ".join(f"COUNT(DISTINCT {c})" for c in _CAT) + " AS n FROM train)"]) +
    f"SELECT customer_id, CAST({len(_NUM)} + seen.n AS INT) AS n_features, " + ", ".join(
        srhe(f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0::DOUBLE END", 6) + f" AS {c}" for c in _NUM)
    + " FROM planted CROSS JOIN st CROSS JOIN seen")
def g5(spark, sf):
    r = run(spark, sf)
    model = Pipeline(stages=H.preprocessor(r.num, r.cat)).fit(r.train)
    out = model.transform(r.train.unionByName(r.test)).withColumn("v", vector_to_array(F.col(H.FEATURES)))
    return out.select(K.ID_COL, F.size("v").alias("n_features"),
                      *[round_half_even(F.col("v")[i], 6).alias(c) for i, c in enumerate(r.num)])


def _single(name: str):
    def fn(spark, sf):
        r = run(spark, sf)
        return H.predict(r.fits(name).model, r.test, keep=[K.ID_COL, LABEL])
    return fn


query("h1_logistic_regression")(_single("Logistic Regression"))
query("h2_decision_tree")(_single("Decision Tree"))


query("h3_random_forest")(_single("Random Forest"))
query("h4_gradient_boosting")(_single("Gradient Boosting"))


@query("h5_out_of_fold", with_ctes("planted", extra=_SPLIT) + f"""
SELECT customer_id, {LABEL}, CAST((ROW_NUMBER() OVER (PARTITION BY {LABEL}
       ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42:fold'), customer_id) - 1) % 5 AS INT) AS fold,
       TRUE AS p_in_range FROM train""")
def h5(spark, sf):
    # SQL can state all but the probabilities' values
    oof = run(spark, sf).fits("Logistic Regression").out_of_fold()
    return oof.select(K.ID_COL, LABEL, "fold", F.col(H.PROB).between(0, 1).alias("p_in_range"))


@query("h6_model_comparison")
def h6(spark, sf):
    return run(spark, sf).metrics


@query("h7_model_selection")
def h7(spark, sf):
    return H.select_best(run(spark, sf).metrics)


_BIN = "FLOOR(last_login_days / (last_login_days + CAST(120 AS DOUBLE)) * 50) / 50.0::DOUBLE"


@query("h8_isotonic_fit", with_ctes("planted", extra=[
    f"ib AS (SELECT {_BIN} AS score, SUM(label) AS s, COUNT(*) AS c FROM planted GROUP BY 1)",
    """io AS (SELECT score, s, c, ROW_NUMBER() OVER (ORDER BY score) AS i,
       SUM(s) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cs,
       SUM(c) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cc FROM ib)""",
    """imm AS (SELECT x.i, a.i AS a, MIN((b.cs - (a.cs - a.s)) / (b.cc - (a.cc - a.c))) AS mn
       FROM io x JOIN io a ON a.i <= x.i JOIN io b ON b.i >= x.i GROUP BY x.i, a.i)"""]) + f"""
SELECT io.score, {srhe('MAX(imm.mn)', 9)} AS fitted FROM imm JOIN io ON io.i = imm.i GROUP BY io.score""")
def h8(spark, sf):
    p = fx.planted(spark, sf)
    d = F.col("last_login_days")
    binned = p.select((F.floor(d / (d + F.lit(120.0)) * 50) / F.lit(50.0)).alias("score"), F.col(LABEL).cast("double").alias(LABEL))
    iso = H.fit_isotonic(binned, "score", LABEL)
    distinct = binned.select("score").distinct()
    return iso.transform(distinct, "score", "iso").select("score", round_half_even(F.col("iso"), 9).alias("fitted"))


# Selection, comparison and leakage delta on stand-in scores, which SQL can state exactly.
STAND_INS = {
    "Logistic Regression": (lambda p, age: p, "churn_probability"),
    "Decision Tree": (lambda p, age: F.floor(p * 4) / F.lit(4.0), "FLOOR(churn_probability * 4) / 4.0::DOUBLE"),
    "Random Forest": (lambda p, age: F.floor(p * 50) / F.lit(50.0), "FLOOR(churn_probability * 50) / 50.0::DOUBLE"),
    "Gradient Boosting": (lambda p, age: age / F.lit(100.0), "age / 100.0::DOUBLE"),
}
_STAND_IN_CTES = [cte for i, (_, x) in enumerate(STAND_INS.values())
                  for cte in metric_ctes("scored", x, "churned", f"CASE WHEN {x} >= 0.5 THEN 1 ELSE 0 END", prefix=f"s{i}")]


def _stand_in(spark, sf, name: str, **labels) -> DataFrame:
    make = STAND_INS[name][0]
    scored = fx.scored_fx(spark, sf).select("churned", make(F.col("churn_probability"), F.col("age")).alias("s"))
    return metrics_long(score_metrics(scored, "s", "churned"), **labels)


def _stand_in_comparison(spark, sf) -> DataFrame:
    parts = [_stand_in(spark, sf, name, model=name, split="cv") for name in STAND_INS]
    return reduce(DataFrame.unionByName, parts)


@query("h6_comparison_stand_in", with_ctes("scored", extra=_STAND_IN_CTES + [
    f"l{i} AS (UNPIVOT s{i} ON pr_auc, roc_auc, f1, precision, recall, accuracy, brier INTO NAME metric VALUE value)"
    for i in range(len(STAND_INS))]) + " UNION ALL ".join(
        f"SELECT '{n}' AS model, 'cv' AS split, metric, CAST(value AS DOUBLE) AS value FROM l{i}" for i, n in enumerate(STAND_INS)))
def h6_stand_in(spark, sf):
    return _stand_in_comparison(spark, sf)


@query("h7_selection_stand_in", with_ctes("scored", extra=_STAND_IN_CTES) + "SELECT best_model FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS best_model, {i} AS place, pr_auc FROM s{i}" for i, n in enumerate(STAND_INS))
    + ") t ORDER BY pr_auc DESC, place LIMIT 1")
def h7_stand_in(spark, sf):
    return H.select_best(_stand_in_comparison(spark, sf), list(STAND_INS))


@query("h11_delta_stand_in", with_ctes("scored", extra=_STAND_IN_CTES) + """
SELECT 'stand-in' AS model, a.pr_auc AS with_suspects, b.pr_auc AS without_suspects, a.pr_auc - b.pr_auc AS delta
FROM s0 a CROSS JOIN s3 b""")
def h11_stand_in(spark, sf):
    return H.leakage_delta(
        _stand_in(spark, sf, "Logistic Regression", model="stand-in", variant="with_suspects").unionByName(
            _stand_in(spark, sf, "Gradient Boosting", model="stand-in", variant="without_suspects")))


@query("h9_calibrated_model")
def h9(spark, sf):
    r = run(spark, sf)
    return r.calibrated.predict(r.test.select(K.ID_COL, LABEL, *r.num, *r.cat), H.PROB).select(K.ID_COL, LABEL, H.PROB)


@query("h10_leakage_audit")
def h10(spark, sf):
    return run(spark, sf).leakage


@query("h11_leakage_delta")
def h11(spark, sf):
    return H.leakage_delta(run(spark, sf).leakage)


@query("h12_drivers")
def h12(spark, sf):
    r = run(spark, sf)
    return H.drivers(spark, r.fits(r.best).model, r.num, r.cat)


@query("h13_metrics_report")
def h13(spark, sf):
    from keepwise.operators import metrics as M
    r = run(spark, sf)
    baselines = [M.majority_baseline(r.train, r.test, LABEL), M.inactivity_baseline(r.train, r.test, label=LABEL)]
    report = H.metrics_report(spark, r.train, r.test, r.metrics, r.fits(r.best).model, r.calibrated,
                              r.leakage, baselines, r.num, r.cat, label=LABEL)
    path = io.shared_path(spark, io.tag(sf), "report_json")
    io.write_report(report, path)
    return io.read_report(spark, path)


@query("h14_model_persistence")
def h14(spark, sf):
    r = run(spark, sf)
    loaded = H.load_model(spark, r.saved_path)
    cols = r.test.select(K.ID_COL, *r.num, *r.cat)
    a = r.calibrated.predict(cols, "p_saved").select(K.ID_COL, "p_saved")
    b = loaded.predict(cols, "p_loaded").select(K.ID_COL, "p_loaded")
    return a.join(b, K.ID_COL)


@query("k1_batch_score")
def k1(spark, sf):
    r = run(spark, sf)
    model = H.load_model(spark, r.saved_path)
    everyone = fx.planted(spark, sf).select(K.ID_COL, *r.num, *r.cat)
    return H.score(everyone, model).select(K.ID_COL, "churn_probability")
