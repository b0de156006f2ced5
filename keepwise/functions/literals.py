"""Small fixed tables built by the JVM from literals (no Python rows in the plan)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` as a table; ``schema`` lists ``name type`` pairs."""
    fields = [f.split() for f in schema.split(", ")]
    table = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows])
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])
    return spark.range(1).select(F.inline(table))
