"""Models H1-H14, batch scoring K1 and the preprocessing pipeline G5.

Logistic regression and the decision tree are Spark ML learners; the forest
and boosting grow the trees of all folds together (``forest``, ``boosting``).
Fits run on executors; the driver receives model parameters and metric rows.
Learners differ from scikit-learn/XGBoost internally, so results are judged by
quality and invariants, never by coefficients.

Preprocessing (scaling, categories, bins) and learners are fitted on all rows.

Differences kept on purpose:
- ``StandardScaler`` divides by the sample std (n - 1) where the reference
  uses the population std; a constant factor sqrt((n-1)/n) on every scaled
  numeric feature.
- Trees choose among at most 256 candidate values of a feature.
- Gradient boosting is built in, so it is never skipped.
- Calibration takes the folds and fold fits of the comparison, so a fold is
  fitted once; the reference draws five folds of its own.
"""
from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions.literals import literal_table
from keepwise.functions.staging import staged
from keepwise.operators.boosting import BLOCK_ROWS, WHOLE_ROWS, BoostSettings, boost
from keepwise.operators.features import feature_columns
from keepwise.operators.forest import Forest, ForestSettings, grow_forests, load_trees, score_by_own, score_forests
from keepwise.operators.isotonic import Isotonic, fit_isotonic
from keepwise.operators.metrics import metrics_long, score_metrics
from keepwise.operators.splits import class_counts, with_class_weight, with_folds
from keepwise.operators.trees import TreeEnsemble, blocks_of, fit_binning, parts_of
from keepwise.session import ensure_checkpoint_dir

MODEL_KEYS = {
    "Logistic Regression": "lr",
    "Decision Tree": "dt",
    "Random Forest": "rf",
    "Gradient Boosting": "gbt",
}
FEATURES = "features"
PROB = "p"


# --- G5 -------------------------------------------------------------------------

def preprocessor(num: list[str], cat: list[str]) -> list:
    """Scale numerics + one-hot categoricals (alphabetical categories; unseen or
    missing -> all zeros); unfitted stages."""
    idx = [f"__{c}_idx" for c in cat]
    ohe = [f"__{c}_ohe" for c in cat]
    return [
        StringIndexer(inputCols=cat, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True),  # drops the indexer's unknown slot
        VectorAssembler(inputCols=num, outputCol="__num", handleInvalid="keep"),
        StandardScaler(inputCol="__num", outputCol="__num_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["__num_scaled", *ohe], outputCol=FEATURES),
    ]


def feature_names(model: PipelineModel, num: list[str], cat: list[str]) -> list[str]:
    """Names of the assembled vector slots: ``feature`` or ``feature_value``."""
    indexer = model.stages[0]
    names = list(num)
    for c, labels in zip(cat, indexer.labelsArray):
        names += [f"{c}_{v}" for v in labels]
    return names


# --- H1-H4 ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Sizes:
    """Sizes of the ensembles; the defaults are the reference's."""
    trees: int = 300
    rounds: int = 400


FULL = Sizes()
Model = PipelineModel | TreeEnsemble | Forest


def make_model(name: str, n_train: int, *, label: str = "label", seed: int = K.RANDOM_STATE, max_bins: int = 256):
    """The two Spark ML learners with the reference settings."""
    key = MODEL_KEYS.get(name, name)
    common = dict(featuresCol=FEATURES, labelCol=label, weightCol="class_weight")
    if key == "lr":
        # tol 1e-4 and 1000 iterations: the reference learner's stopping rule
        return LogisticRegression(maxIter=1000, tol=1e-4, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, **common)
    if key == "dt":
        return DecisionTreeClassifier(maxDepth=6, maxBins=max_bins, seed=seed, **common)
    raise ValueError(f"unknown model {name}")


#: Spark ML fits submitted at a time: each adds jobs, broadcasts and plans to the driver, which has to hold them
FITS_AT_ONCE = 1
#: rows a task of a Spark ML fit takes: fits are long chains of short jobs, which more tasks only slow down
FIT_TASK_ROWS = 20_000


def fit(train: DataFrame, name: str, num: list[str], cat: list[str], *, label: str = "label", sizes: Sizes = FULL) -> Model:
    """Preprocessing and one learner on all rows, which are dealt by id, so
    that a seed gives the same model anywhere."""
    if MODEL_KEYS.get(name, name) in ("rf", "gbt"):
        return _fit_trees(train, name, num, cat, label, 1, None, sizes)[0]
    prepared = Pipeline(stages=preprocessor(num, cat)).fit(train)
    counts = class_counts(train, label)
    n = sum(counts.values())
    rows = train.repartition(max(1, -(-n // FIT_TASK_ROWS)), K.ID_COL).sortWithinPartitions(K.ID_COL)
    rows = prepared.transform(with_class_weight(rows, label, counts)).select(label, "class_weight", FEATURES)
    ensure_checkpoint_dir(rows.sparkSession)
    ready = rows.checkpoint()  # the parts and their order stay: a learner's many jobs start from files, not from the plan
    learner = make_model(name, n, label=label).fit(ready)
    return PipelineModel(stages=[*prepared.stages, learner])


def _fit_trees(train: DataFrame, name: str, num: list[str], cat: list[str], label: str, fits: int, fold: str | None,
               sizes: Sizes) -> list[TreeEnsemble] | list[Forest]:
    """The forest or boosted trees of ``fits`` fits together: fit i leaves out fold i, the last one has all rows."""
    forest = MODEL_KEYS.get(name, name) == "rf"
    binning = fit_binning(train, num, cat)
    n = sum(class_counts(train, label).values())
    block_rows = None if forest else WHOLE_ROWS if n <= WHOLE_ROWS else BLOCK_ROWS
    blocks = blocks_of(train, binning, n, fits, fold, label, block_rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if forest:
            return grow_forests(blocks, fits, binning, ForestSettings(trees=sizes.trees, seed=K.RANDOM_STATE))
        return boost(blocks, fits, parts_of(n, block_rows), binning, BoostSettings(rounds=sizes.rounds, seed=K.RANDOM_STATE))
    finally:
        blocks.unpersist()


def predict(model: Model, df: DataFrame, out: str = PROB, keep: list[str] | None = None) -> DataFrame:
    """Probability of class 1 as a double column."""
    keep = keep if keep is not None else df.columns
    if isinstance(model, Forest):
        if not df.isStreaming:
            return score_forests(df, {out: model}, keep)
        model = model.held
    if isinstance(model, TreeEnsemble):
        return df.select(*keep, model.probability(df.sparkSession).alias(out))
    return model.transform(df).select(*keep, vector_to_array(F.col("probability"))[1].alias(out))


def _in_turn(tables: Iterable[DataFrame]) -> DataFrame:
    """Their union, each written before the next begins: the driver plans and runs one at a time."""
    return reduce(DataFrame.unionByName, [staged(t, "measures") for t in tables])


# --- H5 -------------------------------------------------------------------------------

@dataclass
class Fits:
    """One learner's fits: on all training rows, and per fold on the others.

    ``folded`` are the training rows with their fold, which comparison,
    out-of-fold probabilities and calibration all read.
    """
    name: str
    model: Model
    folds: list[Model]
    folded: DataFrame
    num: list[str]
    cat: list[str]
    label: str

    def out_of_fold(self) -> DataFrame:
        """H5: (id, label, fold, p), each training row scored by the fit that did not see it."""
        keep = [K.ID_COL, self.label, "fold"]
        if all(isinstance(m, Forest) for m in self.folds):  # in one pass
            return score_by_own(self.folded, self.folds, "fold", keep, PROB)
        parts = [predict(m, self.folded.where(F.col("fold") == i), keep=keep) for i, m in enumerate(self.folds)]
        return reduce(DataFrame.unionByName, parts)

    def metrics(self, test: DataFrame) -> DataFrame:
        """H6: pooled out-of-fold (cv) and test metrics, long form."""
        scored = {"cv": self.out_of_fold(), "test": predict(self.model, test, keep=[self.label])}
        return _in_turn(
            metrics_long(score_metrics(df, PROB, self.label), model=self.name, split=split) for split, df in scored.items())


def with_stored_folds(train: DataFrame, *, label: str = "label", k: int = K.CV_FOLDS) -> DataFrame:
    """``train`` with ``fold``, written once to the shared folder: every fit reads the same rows."""
    return staged(with_folds(train, k=k, label=label), "folds")


def fit_folds(folded: DataFrame, name: str, num: list[str], cat: list[str], *, label: str = "label",
              k: int = K.CV_FOLDS, parallelism: int = FITS_AT_ONCE, sizes: Sizes = FULL) -> Fits:
    """The k + 1 fits of one learner.

    Forests and boosted trees of all fits grow together, over bins of all
    training rows. Spark ML fits are submitted from ``parallelism`` driver
    threads, as ``CrossValidator(parallelism=...)`` does (which would return
    averages only); more threads take more of the driver's memory.
    Preprocessing is fitted anew in each.
    """
    if MODEL_KEYS.get(name, name) in ("rf", "gbt"):
        *folds, whole = _fit_trees(folded, name, num, cat, label, k + 1, "fold", sizes)
        return Fits(name, whole, folds, folded, num, cat, label)

    def one(i: int) -> Model:
        rows = folded if i == k else folded.where(F.col("fold") != i)
        return fit(rows.drop("fold"), name, num, cat, label=label, sizes=sizes)

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k + 1))) as pool:
        *folds, whole = pool.map(one, range(k + 1))
    return Fits(name, whole, folds, folded, num, cat, label)


# --- H8 / H9 --------------------------------------------------------------------------

@dataclass
class CalibratedModel:
    """Ensemble of (model, isotonic) pairs; prediction = their average."""
    parts: list[tuple[Model, Isotonic]]
    num: list[str] = field(default_factory=list)
    cat: list[str] = field(default_factory=list)
    name: str = ""

    def predict(self, df: DataFrame, out: str = "churn_probability") -> DataFrame:
        """``df`` with the calibrated probability of class 1."""
        raw, cal = ([f"__{kind}{i}" for i in range(len(self.parts))] for kind in ("raw", "cal"))
        cur = df
        if all(isinstance(m, Forest) for m, _ in self.parts) and not df.isStreaming:  # in one pass
            cur = score_forests(df, {c: m for (m, _), c in zip(self.parts, raw)}, df.columns)
        else:
            for (m, _), c in zip(self.parts, raw):
                cur = predict(m, cur, out=c)
        for (_, iso), a, b in zip(self.parts, raw, cal):
            cur = iso.transform(cur, a, b)
        total = reduce(lambda x, y: x + y, [F.col(c) for c in cal])
        return cur.select(*df.columns, (total / F.lit(float(len(cal)))).alias(out))


def calibrate(fits: Fits) -> CalibratedModel:
    """H9: per fold an isotonic fit on the held-out rows over the fit on the
    others; the calibrated probability is the average of the k outputs."""
    parts = []
    for i, m in enumerate(fits.folds):
        held = predict(m, fits.folded.where(F.col("fold") == i), keep=[fits.label])
        parts.append((m, fit_isotonic(held, PROB, fits.label)))
    return CalibratedModel(parts, fits.num, fits.cat, fits.name)


# --- H6 / H7 / H10 / H11 / H12 ----------------------------------------------------------

def compare_models(train: DataFrame, test: DataFrame, names: list[str], *, label: str = "label",
                   drop: tuple = (), sizes: Sizes = FULL) -> tuple[DataFrame, dict[str, Fits]]:
    """H6: per model CV (pooled out-of-fold) and test metrics, long form, and
    each model's fits, which calibration and the audit go on from."""
    num, cat = feature_columns(drop)
    folded = with_stored_folds(train, label=label)   # once, for all models

    # one learner after the other: the driver holds the jobs of ``FITS_AT_ONCE`` fits, not of all
    fits = {n: fit_folds(folded, n, num, cat, label=label, sizes=sizes) for n in names}
    return reduce(DataFrame.unionByName, [f.metrics(test) for f in fits.values()]), fits


def select_best(metrics: DataFrame, order: list[str] = K.MODEL_ORDER) -> DataFrame:
    """H7: best pooled CV PR-AUC; the first model in ``order`` wins a tie."""
    pos = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    cv = metrics.where((F.col("split") == "cv") & (F.col("metric") == "pr_auc"))
    best = cv.agg(F.min_by(F.col("model"), F.struct(-F.col("value"), pos[F.col("model")])).alias("best_model"))
    return best


def leakage_audit(train: DataFrame, test: DataFrame, fits: Fits, *,
                  suspects: list[str] = K.LEAKAGE_SUSPECTS, sizes: Sizes = FULL) -> DataFrame:
    """Test metrics of a model with and without the leakage suspects,
    long form (model, variant, metric, value)."""
    without = fit(train, fits.name, *feature_columns(suspects), label=fits.label, sizes=sizes)
    variants = {"with_suspects": fits.model, "without_suspects": without}
    return _in_turn(
        metrics_long(score_metrics(predict(m, test, keep=[fits.label]), PROB, fits.label), model=fits.name, variant=variant)
        for variant, m in variants.items())


def leakage_delta(metrics: DataFrame) -> DataFrame:
    """PR-AUC with minus without the suspects (pivot + subtraction)."""
    pr = metrics.where(F.col("metric") == "pr_auc")
    wide = pr.groupBy("model").pivot("variant", ["with_suspects", "without_suspects"]).agg(F.first("value"))
    return wide.select("model", "with_suspects", "without_suspects",
                       (F.col("with_suspects") - F.col("without_suspects")).alias("delta"))


#: what a fitted learner tells of its features, by attribute
_WEIGHTS = {"featureImportances": lambda v: v.toArray(), "coefficients": lambda v: abs(v.toArray())}


def drivers(spark: SparkSession, model: Model, num: list[str], cat: list[str], n: int = 15) -> DataFrame:
    """Top-n features by tree importance or |coefficient| (a row per vector slot, ranked in Spark)."""
    if isinstance(model, TreeEnsemble | Forest):
        names, weights = model.binning.names, model.importances
    else:
        learner = model.stages[-1]
        names = feature_names(model, num, cat)
        weights = next((f(getattr(learner, a)) for a, f in _WEIGHTS.items() if hasattr(learner, a)), [])
    slots = [(i, f, float(w)) for i, (f, w) in enumerate(zip(names, weights))]
    table = literal_table(spark, slots, "slot int, feature string, importance double")
    return table.orderBy(F.desc("importance"), "slot").limit(n).select("feature", "importance")


# --- H13 -----------------------------------------------------------------------------------

def metrics_report(spark: SparkSession, train: DataFrame, test: DataFrame, comparison: DataFrame,
                   best_model: Model, calibrated: CalibratedModel, leakage: DataFrame,
                   baselines: list[DataFrame], num: list[str], cat: list[str], *,
                   label: str = "label") -> DataFrame:
    """One long table (section, name, metric, value) with every part of
    the report: dataset size and churn rate, best model, model metrics,
    baselines, calibrated test metrics, leakage audit and drivers."""
    ds = train.unionByName(test).agg(F.count(F.lit(1)).cast("double").alias("rows"), F.avg(label).alias("churn_rate"))
    parts = [
        ds.select(F.lit("dataset").alias("section"), F.lit("all").alias("name"),
                  F.inline(F.array(F.struct(F.lit("rows").alias("metric"), F.col("rows").alias("value")),
                                   F.struct(F.lit("churn_rate").alias("metric"), F.col("churn_rate").alias("value"))))),
        select_best(comparison).select(F.lit("best_model").alias("section"), F.col("best_model").alias("name"),
                                       F.lit("selected").alias("metric"), F.lit(1.0).alias("value")),
        comparison.select(F.lit("models").alias("section"), F.concat_ws("/", "model", "split").alias("name"),
                          "metric", "value"),
        metrics_long(score_metrics(calibrated.predict(test.select(label, *num, *cat), PROB), PROB, label),
                     section="calibrated_test", name=calibrated.name),
        leakage.select(F.lit("leakage_audit").alias("section"), F.col("variant").alias("name"), "metric", "value"),
        drivers(spark, best_model, num, cat).select(
            F.lit("drivers").alias("section"), F.col("feature").alias("name"), F.lit("importance").alias("metric"),
            F.col("importance").alias("value")),
    ]
    for b in baselines:
        parts.append(metrics_long(b, keep=["name"], section="baselines"))
    parts.append(literal_table(spark, [("leakage_suspects", c, "suspect", 1.0) for c in K.LEAKAGE_SUSPECTS],
                               "section string, name string, metric string, value double"))
    return _in_turn(p.select("section", "name", "metric", F.col("value").cast("double")) for p in parts)


# --- H14 ----------------------------------------------------------------------------------

def save_model(spark: SparkSession, model: CalibratedModel, path: str) -> None:
    """A folder per ensemble part (MLWriter or tree tables, and the isotonic table) + the feature lists."""
    def save(i: int) -> None:
        m, iso = model.parts[i]
        if isinstance(m, TreeEnsemble | Forest):
            m.save(spark, f"{path}/part{i}/trees")
        else:
            m.write().overwrite().save(f"{path}/part{i}/pipeline")
        iso.save(f"{path}/part{i}/isotonic")

    for i in range(len(model.parts)):  # a part at a time, as folds are fitted
        save(i)
    trees = all(isinstance(m, TreeEnsemble | Forest) for m, _ in model.parts)
    meta = json.dumps({"num": model.num, "cat": model.cat, "name": model.name, "parts": len(model.parts), "trees": trees})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> CalibratedModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])

    def load(i: int) -> tuple[Model, Isotonic]:
        m = load_trees(spark, f"{path}/part{i}/trees") if meta["trees"] else PipelineModel.load(f"{path}/part{i}/pipeline")
        return m, Isotonic.load(spark, f"{path}/part{i}/isotonic")

    return CalibratedModel([load(i) for i in range(meta["parts"])], meta["num"], meta["cat"], meta["name"])


# --- K1 -------------------------------------------------------------------------------------

def score(df: DataFrame, model: CalibratedModel | None) -> DataFrame:
    """K1: calibrated churn probability for every customer; error without a model."""
    if model is None:
        raise FileNotFoundError("no model to score with; run the train job, which saves one")
    return model.predict(df, "churn_probability")
