"""Invariants of the rows-only operators on the planted fixture."""
import pytest
from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.operators import models as H
from tests.conftest import SF001


@pytest.fixture(scope="module")
def qs():
    from keepwise.plans.registry import queries
    return queries()


def test_preprocess_vector_size(spark, qs):
    from keepwise.plans.q_models import run
    r = run(spark, SF001)
    n_cat = sum(r.train.select(c).distinct().count() for c in r.cat)
    sizes = {x[0] for x in qs["g5_preprocess_pipeline"](spark, SF001).select("n_features").collect()}
    assert sizes == {len(r.num) + n_cat}


def test_model_comparison_shape_and_range(spark, qs):
    m = qs["h6_model_comparison"](spark, SF001)
    assert m.count() == len(K.MODEL_ORDER) * 2 * 7
    bad = m.where(F.col("value").isNotNull() & ((F.col("value") < 0) | (F.col("value") > 1))).count()
    assert bad == 0
    assert qs["h7_model_selection"](spark, SF001).first()["best_model"] in K.MODEL_ORDER


def test_out_of_fold_covers_every_train_row_once(spark, qs):
    from keepwise.plans.q_models import run
    oof = qs["h5_out_of_fold"](spark, SF001)
    n_train = run(spark, SF001).train.count()
    assert oof.count() == n_train == oof.select(K.ID_COL).distinct().count()


def test_probabilities_in_range(spark, qs):
    for key in ["h1_logistic_regression", "h2_decision_tree", "h3_random_forest", "h4_gradient_boosting",
                "h9_calibrated_model"]:
        df = qs[key](spark, SF001)
        assert df.where((F.col("p") < 0) | (F.col("p") > 1) | F.col("p").isNull()).count() == 0, key


def test_planted_signal_is_learned(spark, qs):
    m = qs["h6_model_comparison"](spark, SF001)
    best = m.where("split = 'test' AND metric = 'roc_auc'").agg(F.max("value")).first()[0]
    assert best > 0.8


def test_decision_tree_depth(spark):
    from keepwise.plans.q_models import run
    r = run(spark, SF001)
    assert r.fits("Decision Tree").model.stages[-1].depth <= 6


def test_drivers_sorted_and_bounded(spark, qs):
    rows = qs["h12_drivers"](spark, SF001).collect()
    imps = [r["importance"] for r in rows]
    assert len(rows) <= 15 and imps == sorted(imps, reverse=True)


def test_leakage_rows(spark, qs):
    assert qs["h10_leakage_audit"](spark, SF001).count() == 14
    assert qs["h11_leakage_delta"](spark, SF001).count() == 1


def test_persistence_round_trip(spark, qs):
    df = qs["h14_model_persistence"](spark, SF001)
    assert df.where(F.abs(F.col("p_saved") - F.col("p_loaded")) > 1e-12).count() == 0


def test_batch_score_one_row_per_customer(spark, qs):
    df = qs["k1_batch_score"](spark, SF001)
    assert df.count() == df.select(K.ID_COL).distinct().count() == 150


def test_metrics_report_sections(spark, qs):
    sections = {r[0] for r in qs["h13_metrics_report"](spark, SF001).select("section").distinct().collect()}
    assert {"dataset", "best_model", "models", "baselines", "calibrated_test", "leakage_audit", "drivers"} <= sections


def test_logistic_regression_converged(spark):
    from keepwise.plans.q_models import run
    lr = run(spark, SF001).fits("Logistic Regression").model.stages[-1]
    hist = lr.summary.objectiveHistory
    assert lr.summary.totalIterations < 1000 and hist[-1] <= hist[0]


def test_random_forest_same_seed_same_output(spark):
    from keepwise.operators import models as H
    from keepwise.plans.q_models import run
    r = run(spark, SF001)
    a = H.predict(H.fit(r.train, "Random Forest", r.num, r.cat, sizes=H.Sizes(20, 10)), r.test, keep=[K.ID_COL])
    b = H.predict(H.fit(r.train, "Random Forest", r.num, r.cat, sizes=H.Sizes(20, 10)), r.test, keep=[K.ID_COL])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_boosting_train_logloss_falls_with_rounds(spark):
    import numpy as np
    from keepwise.plans.q_models import run
    r = run(spark, SF001)
    m = r.fits("Gradient Boosting").model
    rows = r.train.select("label", *r.num, *r.cat).toPandas()
    y, bins = rows["label"].to_numpy(), m.binning.bins(rows)
    losses = []
    for rounds in range(1, len(m.roots) + 1, 10):
        p = m.probabilities(bins, rounds)
        losses.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert len(m.roots) == 400 and losses[-1] < losses[0]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))


def test_calibration_does_not_hurt_brier(spark, qs):
    from keepwise.operators.metrics import score_metrics
    from keepwise.plans.q_models import run
    r = run(spark, SF001)
    cal = score_metrics(qs["h9_calibrated_model"](spark, SF001), "p", "label").first()["brier"]
    raw = r.metrics.where(f"model = '{r.best}' AND split = 'test' AND metric = 'brier'").first()["value"]
    assert cal <= raw + 0.05


def test_leakage_drop_positive_on_planted_signal(spark, qs):
    assert qs["h11_leakage_delta"](spark, SF001).first()["delta"] > 0


def test_train_means_are_near_zero(spark):
    """Of every scaled feature, before the query rounds it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from keepwise.operators import models as H
    from keepwise.plans.q_models import run
    r = run(spark, SF001)
    scaled = Pipeline(stages=H.preprocessor(r.num, r.cat)).fit(r.train).transform(r.train)
    v = vector_to_array(F.col(H.FEATURES))
    means = scaled.agg(*[F.avg(v[i]) for i in range(len(r.num))]).first()
    assert all(abs(m) < 1e-9 for m in means)


def test_importances_sum_to_one(spark):
    from keepwise.plans.q_models import run
    r = run(spark, SF001)
    assert abs(sum(r.fits("Decision Tree").model.stages[-1].featureImportances.toArray()) - 1) < 1e-9
    for name in ("Random Forest", "Gradient Boosting"):
        m = r.fits(name).model
        assert abs(m.importances.sum() - 1) < 1e-9 and len(m.importances) == len(m.binning.names)


def test_default_sizes_are_the_reference_ones():
    from keepwise.operators.boosting import BoostSettings
    from keepwise.operators.models import FULL
    assert (FULL.trees, FULL.rounds) == (300, 400)
    s = BoostSettings()
    assert (s.depth, s.rate, s.rows, s.columns, s.l2, s.least) == (5, 0.05, 0.9, 0.9, 1.0, 1.0)


def test_logistic_gradient_is_near_zero(spark):
    """The penalised loss has no slope left at the fitted coefficients."""
    import numpy as np

    from keepwise.operators.splits import with_class_weight
    from keepwise.plans.q_models import LABEL, run
    r = run(spark, SF001)
    m = r.fits("Logistic Regression").model
    rows = m.transform(with_class_weight(r.train, LABEL)).select("features", LABEL, "class_weight", "probability").collect()
    x = np.array([row[0].toArray() for row in rows])
    y, w = np.array([row[1] for row in rows], float), np.array([row[2] for row in rows])
    p = np.array([row[3][1] for row in rows])
    slope = (x * (w * (p - y))[:, None]).sum(0) / w.sum() + m.stages[-1].coefficients.toArray() / len(rows)
    assert abs(slope).max() < 5e-3


def test_tree_leaves_hold_weighted_means(spark):
    """Rows of equal features class by class: a leaf's probability is its weighted share."""
    from keepwise.operators.splits import with_class_weight
    from keepwise.plans.q_models import LABEL, run
    r = run(spark, SF001)
    m = r.fits("Decision Tree").model
    learner = m.stages[-1].setLeafCol("leaf")
    rows = with_class_weight(r.train, LABEL)
    for stage in m.stages[:-1]:
        rows = stage.transform(rows)
    from pyspark.ml.functions import vector_to_array
    out = learner.transform(rows).select("leaf", vector_to_array("probability")[1].alias("p"), LABEL, "class_weight")
    means = out.groupBy("leaf").agg((F.sum(F.col(LABEL) * F.col("class_weight")) / F.sum("class_weight")).alias("mean"), F.max("p").alias("p"))
    assert means.where(F.abs(F.col("mean") - F.col("p")) > 1e-9).count() == 0


def test_report_names_baselines_and_suspects(spark, qs):
    rows = qs["h13_metrics_report"](spark, SF001).collect()
    names = {r["name"] for r in rows if r["section"] == "baselines"}
    assert len(names) == 2 and "Majority class" in names
    assert {r["name"] for r in rows if r["section"] == "leakage_suspects"} == set(K.LEAKAGE_SUSPECTS)


def test_driver_submits_few_fits_at_once(spark, monkeypatch):
    import threading
    import time

    going, most, lock = 0, 0, threading.Lock()

    def fit(rows, name, *args, **kwargs):
        nonlocal going, most
        with lock:
            going += 1
            most = max(most, going)
        time.sleep(0.2)
        with lock:
            going -= 1
        return name, sorted(r["customer_id"] for r in rows.collect())

    rows = spark.createDataFrame([(i, i % 2) for i in range(40)], "customer_id long, label int")
    monkeypatch.setattr(H, "fit", fit)
    monkeypatch.setattr(H, "predict", lambda model, df, out=H.PROB, keep=None: df.select(*keep, F.lit(0.5).alias(out)))
    metrics, fits = H.compare_models(rows, rows, ["Logistic Regression", "Decision Tree"])
    plan = metrics._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Relation") == 4  # each part was computed on its own
    assert metrics.count() == 2 * 2 * 7
    assert most <= H.FITS_AT_ONCE < K.CV_FOLDS + 1
    for name, f in fits.items():
        assert f.model == (name, list(range(40))) and len(f.folds) == K.CV_FOLDS
        held = [set(range(40)) - set(ids) for _, ids in f.folds]
        assert sorted(i for h in held for i in h) == list(range(40)) and all(h for h in held)


def test_learner_starts_from_stored_rows(spark, monkeypatch):
    from pyspark.ml import Pipeline

    seen, make = [], H.make_model

    class Watched:
        def __init__(self, learner):
            self.learner = learner

        def fit(self, rows):
            seen.append(rows)
            return self.learner.fit(rows)

    monkeypatch.setattr(H, "make_model", lambda *a, **b: Watched(make(*a, **b)))
    monkeypatch.setattr(H, "FIT_TASK_ROWS", 40)
    data = [(i % 90, float(i % 7), None if i % 11 == 0 else float(i), "ab"[i % 2] if i % 5 else None, int(i % 7 > 3)) for i in range(100)]
    train = spark.createDataFrame(data, f"{K.ID_COL} long, x double, y double, c string, label int").fillna({"y": 0.0})
    fits = {name: H.fit(train, name, ["x", "y"], ["c"]) for name in ("Logistic Regression", "Decision Tree")}
    stages = Pipeline(stages=H.preprocessor(["x", "y"], ["c"])).fit(train)
    counts = {0: train.where("label = 0").count(), 1: train.where("label = 1").count()}
    dealt = train.repartition(3, K.ID_COL).sortWithinPartitions(K.ID_COL)
    wanted = stages.transform(H.with_class_weight(dealt, "label", counts)).select("label", "class_weight", H.FEATURES)
    parts = lambda df: df.rdd.glom().map(lambda p: [tuple(r) for r in p]).collect()
    for rows in seen:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" in plan and "Exchange" not in plan and "UDF" not in plan  # what each job of a fit carries
        assert [sorted(map(str, p)) for p in parts(rows)] == [sorted(map(str, p)) for p in parts(wanted)]
        assert rows.schema[H.FEATURES].metadata == wanted.schema[H.FEATURES].metadata  # tells binary features
    for name, model in fits.items():
        direct = make(name, len(data)).fit(wanted).transform(wanted).select("probability").collect()
        ours = model.transform(dealt).select("probability").collect()
        assert sorted(round(float(r[0][1]), 9) for r in ours) == sorted(round(float(r[0][1]), 9) for r in direct)


def test_parts_are_saved_and_loaded_in_turn(spark, tmp_path, monkeypatch):
    import threading
    import time

    going, most, lock = 0, 0, threading.Lock()

    def watched(f):
        def g(*args, **kwargs):
            nonlocal going, most
            with lock:
                going += 1
                most = max(most, going)
            time.sleep(0.1)
            try:
                return f(*args, **kwargs)
            finally:
                with lock:
                    going -= 1
        return g

    rows = spark.createDataFrame([(i / 10, float(i > 4 + k)) for i in range(10) for k in range(3)], "p double, label double")
    monkeypatch.setattr(H.Isotonic, "save", watched(H.Isotonic.save))
    monkeypatch.setattr(H.Isotonic, "load", watched(H.Isotonic.load))
    train = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2], int(i % 7 > 3)) for i in range(60)], f"{K.ID_COL} long, x double, c string, label int")
    fitted = H.fit(train, "Decision Tree", ["x"], ["c"])
    model = H.CalibratedModel([(fitted, H.fit_isotonic(rows))] * 3, ["x"], ["c"], "Decision Tree")
    H.save_model(spark, model, str(tmp_path / "m"))
    loaded = H.load_model(spark, str(tmp_path / "m"))
    assert most == 1 and len(loaded.parts) == 3
    got = [[r["p"] for r in m.predict(train, "p").orderBy(K.ID_COL).collect()] for m in (model, loaded)]
    assert got[0] == got[1] and len(got[0]) == 60


def test_out_of_fold_of_forests_in_one_pass(spark, monkeypatch):
    from keepwise.operators import forest

    rows = spark.createDataFrame([(i, float(i % 13) if i % 9 else None, "abc"[i % 3] if i % 4 else None, int(i % 13 > 6), i % 5 if i % 7 else 2) for i in range(300)],
                                 f"{K.ID_COL} long, x double, c string, label int, fold int")
    fits = H.fit_folds(rows, "Random Forest", ["x"], ["c"], sizes=H.Sizes(trees=7))
    parts = [H.predict(m, rows.where(F.col("fold") == i), keep=[K.ID_COL, "label", "fold"]) for i, m in enumerate(fits.folds)]
    wanted = sorted(tuple(r) for p in parts for r in p.collect())
    written, stage = [], forest.staged
    monkeypatch.setattr(forest, "staged", lambda df, name, *a, **b: written.append(name) or stage(df, name, *a, **b))
    assert sorted(tuple(r) for r in fits.out_of_fold().collect()) == wanted and len(wanted) == 300
    assert written == ["blocks", "scored"]  # once, not once a fold: each costs the driver its jobs
    assert fits.out_of_fold().columns == [K.ID_COL, "label", "fold", H.PROB]
    assert forest.score_by_own(rows.withColumn("fold", F.when(F.col("fold") < 4, F.col("fold"))), fits.folds, "fold", [K.ID_COL], "p").count() == sum(r[2] < 4 for r in wanted)
    assert forest.score_by_own(rows.limit(0), fits.folds, "fold", [K.ID_COL], "p").count() == 0


def test_learners_take_all_rows(spark, monkeypatch):
    seen, make, deal = [], H.make_model, H.blocks_of

    class Watched:
        def __init__(self, learner):
            self.learner = learner

        def fit(self, rows):
            seen.append([rows.count()])
            return self.learner.fit(rows)

    def dealt(*args, **kwargs):
        blocks = deal(*args, **kwargs)
        sizes = dict(blocks.map(lambda b: (b.fit, len(b.y))).reduceByKey(lambda a, b: a + b).collect())
        seen.append([sizes[f] for f in sorted(sizes)])
        return blocks

    for bound in ("MAX_FIT_ROWS", "FOREST_ROWS"):  # rows beyond these were left out
        monkeypatch.setattr(H, bound, 60, raising=False)
    monkeypatch.setattr(H, "make_model", lambda *a, **b: Watched(make(*a, **b)))
    monkeypatch.setattr(H, "blocks_of", dealt)
    data = [(i % 190 if i % 17 else None, float(i % 7), "ab"[i % 2], int(i % 7 > 3), i % 5) for i in range(200)]  # keys repeat or are missing
    train = spark.createDataFrame(data, f"{K.ID_COL} long, x double, c string, label int, fold int")
    for name in K.MODEL_ORDER:
        seen.clear()
        H.fit_folds(train, name, ["x"], ["c"], sizes=H.Sizes(trees=3, rounds=3))
        assert [n for rows in seen for n in rows] == [160] * 5 + [200], name


def test_a_forest_is_sent_to_slices_of_its_own_rows_only(spark, monkeypatch):
    import re

    from keepwise.operators import forest

    rows = spark.createDataFrame([(i, float(i % 13), "abc"[i % 3], int(i % 13 > 6), i % 5) for i in range(300)],
                                 f"{K.ID_COL} long, x double, c string, label int, fold int")
    fits = H.fit_folds(rows, "Random Forest", ["x"], ["c"], sizes=H.Sizes(trees=5))
    plans, stage = {}, forest.staged
    monkeypatch.setattr(forest, "SCORED_ROWS", 60)
    monkeypatch.setattr(forest, "staged", lambda df, name, *a, **b: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or stage(df, name, *a, **b))
    assert fits.out_of_fold().count() == 300
    slices = lambda: re.findall(r"pmod\(xxhash64\([^)]*\), (\d+)\)", plans["scored"])
    assert set(slices()) == {"1"}  # a fold has 60 rows
    assert H.predict(fits.model, rows, keep=[K.ID_COL]).count() == 300 and set(slices()) == {"5"}
