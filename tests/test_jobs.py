"""The three entry points end to end: raw CSV -> clean -> model -> scored table."""
import tempfile

from pyspark.sql import functions as F

from keepwise import jobs
from keepwise.plans import fixtures as fx
from keepwise.sources import io
from tests.conftest import SF001


def test_etl_train_score(spark):
    base = tempfile.mkdtemp(prefix="kw-jobs-")
    io.write_raw_csv(fx.raw_table(spark, SF001), f"{base}/raw")
    clean = jobs.etl(spark, f"{base}/raw", f"{base}/clean", fact="fact_jobs_test")
    assert clean.count() == fx.clean_table(spark, SF001).count()
    report = jobs.train(spark, f"{base}/clean", f"{base}/model", f"{base}/report", models=["Logistic Regression", "Decision Tree"])
    sections = {r[0] for r in report.select("section").distinct().collect()}
    assert {"dataset", "best_model", "models", "baselines", "calibrated_test", "leakage_audit", "drivers"} <= sections
    scored = jobs.score(spark, f"{base}/clean", f"{base}/model", f"{base}/scored")
    assert scored.count() == clean.count() == scored.select("customer_id").distinct().count()
    assert scored.where((F.col("churn_probability") < 0) | (F.col("churn_probability") > 1)).count() == 0
