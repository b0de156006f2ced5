"""The three batch entry points, as Spark jobs:

    python -m keepwise.jobs etl   --raw RAW_CSV --clean CLEAN_DIR
    python -m keepwise.jobs train --clean CLEAN_DIR --model MODEL_DIR --report REPORT_DIR
    python -m keepwise.jobs score --clean CLEAN_DIR --model MODEL_DIR --scored SCORED_DIR

ETL reads the raw CSV, cleans it and writes the clean table (and registers the
fact table and KPI views). Training derives features, splits, compares the
four learners, calibrates the best one, audits leakage, saves the model and
writes the report. Scoring applies the saved model to every customer and
writes the scored table, partitioned by tier.
"""
from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.operators import cleaning, features, metrics as M, models as H, scoring
from keepwise.operators.splits import stratified_split
from keepwise.sources import io


def etl(spark: SparkSession, raw_path: str, clean_path: str, fact: str | None = "fact_subscriber") -> DataFrame:
    raw = io.read_raw_csv(spark, raw_path)
    clean = cleaning.clean(raw)
    io.write_clean(clean, clean_path)
    out = io.read_clean(spark, clean_path)
    if fact:
        io.save_fact(out, fact)
        io.register_views(spark, fact)
    return out


def _features(spark: SparkSession, clean_path: str) -> DataFrame:
    return features.add_engineered(io.read_clean(spark, clean_path)).persist()


def train(spark: SparkSession, clean_path: str, model_path: str, report_path: str, *,
          models: list[str] = K.MODEL_ORDER) -> DataFrame:
    df = _features(spark, clean_path)
    sp = stratified_split(df).persist()
    tr = sp.where("split = 'train'").drop("split").persist()
    te = sp.where("split = 'test'").drop("split").persist()
    num, cat = features.feature_columns()
    comparison, fits = H.compare_models(tr, te, models, label=K.TARGET)
    comparison = comparison.persist()
    best = H.select_best(comparison).first()["best_model"]
    calibrated = H.calibrate(fits[best])
    leakage = H.leakage_audit(tr, te, fits[best])
    baselines = [M.majority_baseline(tr, te, K.TARGET), M.inactivity_baseline(tr, te, label=K.TARGET)]
    report = H.metrics_report(spark, tr, te, comparison, fits[best].model, calibrated, leakage, baselines,
                              num, cat, label=K.TARGET)
    H.save_model(spark, calibrated, model_path)
    io.write_report(report, report_path)
    return io.read_report(spark, report_path)


def score(spark: SparkSession, clean_path: str, model_path: str, scored_path: str) -> DataFrame:
    df = _features(spark, clean_path)
    model = H.load_model(spark, model_path)
    scored = scoring.build_scored(H.score(df, model))
    io.write_scored(scored, scored_path)
    out = io.read_scored(spark, scored_path, scoring.SCORED_COLUMNS)
    return out


def _summary(scored: DataFrame) -> dict:
    row = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.avg("churn_probability").alias("mean_p"),
        F.count_if(F.col("risk_tier") == "High").alias("high"), F.sum("revenue_at_risk").alias("rar"),
    ).first()
    return row.asDict()


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="keepwise.jobs")
    ap.add_argument("job", choices=["etl", "train", "score"])
    ap.add_argument("--raw")
    ap.add_argument("--clean", required=True)
    ap.add_argument("--model")
    ap.add_argument("--report")
    ap.add_argument("--scored")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"keepwise-{a.job}").getOrCreate()
    from keepwise.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    if a.job == "etl":
        print(cleaning.quality_report(io.read_raw_csv(spark, a.raw)).first().asDict())
        etl(spark, a.raw, a.clean)
    elif a.job == "train":
        train(spark, a.clean, a.model, a.report).where("section = 'best_model'").show(truncate=False)
    else:
        print(_summary(score(spark, a.clean, a.model, a.scored)))


if __name__ == "__main__":
    main()
