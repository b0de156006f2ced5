"""Intermediate tables written to the shared folder the cluster names."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from keepwise.session import ensure_checkpoint_dir


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once and read back: its lineage ends in files every executor sees, in folders ``by`` a column."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keepwise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
