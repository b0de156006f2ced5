"""The scoring chain (probability -> tier -> revenue at risk -> action -> key
factor) on a Structured Streaming source.

Stateless: every micro-batch is scored with the same expressions as the batch
table (``operators.scoring.build_scored``). The key-factor medians are those of
a reference table, since "all scored rows" is unbounded on a stream. Output
goes through Spark's parquet file sink, which records the files of each batch, so a
batch that is tried again is not written twice; the stream's checkpoint folder
makes a restart resume where it stopped.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from keepwise.operators import scoring
from keepwise.operators.models import CalibratedModel


def scored_stream(stream: DataFrame, meds: tuple[float, float, float],
                  model: CalibratedModel | None = None) -> DataFrame:
    """Score a streaming DataFrame of subscriber rows (same columns as ``sub``).

    Without a model the rows must already carry ``churn_probability``.
    """
    with_p = model.predict(stream, "churn_probability") if model is not None else stream
    return scoring.build_scored(with_p, meds)


def start_scoring(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str,
                  meds: tuple[float, float, float], model: CalibratedModel | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Read new parquet files under ``source``, score them, append to ``sink``."""
    stream = spark.readStream.schema(schema).parquet(source)
    out = scored_stream(stream, meds, model)

    w = out.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
