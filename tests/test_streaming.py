"""The streaming scoring chain gives the batch answer."""
import tempfile

from keepwise.operators import scoring
from keepwise.plans import fixtures as fx
from keepwise.streaming.scoring import start_scoring
from tests.conftest import SF001


def test_stream_scoring_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="kw-stream-")
    rows = fx.stand_in_score(fx.sub(spark, SF001))
    rows.repartition(3).write.parquet(f"{base}/in")
    meds = scoring.key_factor_medians(rows)
    q = start_scoring(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/ckpt", meds)
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{base}/out").select(*scoring.SCORED_COLUMNS).collect()))
    want = sorted(map(tuple, scoring.build_scored(rows, meds).collect()))
    assert got == want and len(got) == 150


def test_stream_scoring_with_calibrated_model_equals_batch(spark):
    from keepwise.plans.q_models import run

    base = tempfile.mkdtemp(prefix="kw-stream-model-")
    model = run(spark, SF001).calibrated
    rows = fx.planted(spark, SF001).drop("base", "label")
    rows.repartition(2).write.parquet(f"{base}/in")
    meds = scoring.key_factor_medians(rows)
    q = start_scoring(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/ckpt", meds, model=model)
    q.awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(f"{base}/out").select(*scoring.SCORED_COLUMNS).collect()))
    want = sorted(map(tuple, scoring.build_scored(model.predict(rows), meds).collect()))
    assert got == want and len(got) == 150
