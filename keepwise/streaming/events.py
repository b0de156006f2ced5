"""Event-time aggregation on a stream: watermark, windows, late rows, deduplication with expiry.

``windows`` is the stateful query: events that come again within the watermark
count once, a window is given out when the watermark passes its end, and its
state goes. Spark drops rows that come later than that; ``split_late`` tells
them apart by the same rule and keeps them. Its two tables are written per
batch, each batch over what an earlier try of it left, so a batch that is
tried again changes nothing.
"""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windows(stream: DataFrame, time: str, delay: str, length: str, by: list[str], event_id: str, value: str) -> DataFrame:
    """window_start, by, events and total (of cents) of each closed window."""
    unique = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([event_id])
    grouped = unique.groupBy(F.window(time, length), *by).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col(value).cast("decimal(18,2)")).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), *by, "events", F.col("total").cast("double").alias("total"))


def start_windows(stream: DataFrame, sink: str, checkpoint: str, **options) -> StreamingQuery:
    """``windows`` into a parquet table, up to what is there now."""
    writer = windows(stream, **options).writeStream.format("parquet").outputMode("append")
    return writer.option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(spark: SparkSession, batch: DataFrame, batch_id: int, path: str, time: str, delay: timedelta) -> None:
    """Writes a batch's rows to ``on_time`` or ``late`` under ``path``.

    A row is late if it is not after the watermark that the batch before used
    to close windows, which is what Spark drops rows by: the latest time of
    the batches before that one less ``delay``, in whole milliseconds.
    """
    latest = None
    if batch_id > 1:
        seen = spark.read.schema("batch int, latest timestamp").parquet(f"{path}/progress").where(F.col("batch") < batch_id - 1)
        latest = seen.agg(F.max("latest").alias("latest")).first()["latest"]
    held = batch.persist()
    try:
        late = F.lit(False)
        if latest is not None:
            mark = latest - delay
            mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000)
            late = F.coalesce(F.col(time) <= F.lit(mark), F.lit(False))
        for name, rows in (("late", held.where(late)), ("on_time", held.where(~late))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        held.agg(F.max(F.col(time)).cast("timestamp").alias("latest")).write.mode("overwrite").parquet(f"{path}/progress/batch={batch_id}")
    finally:
        held.unpersist()


def start_split(stream: DataFrame, path: str, checkpoint: str, time: str, delay: timedelta) -> StreamingQuery:
    """``split_late`` of all batches, up to what is there now."""
    def each(batch: DataFrame, batch_id: int) -> None:
        split_late(batch.sparkSession, batch, batch_id, path, time, delay)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
