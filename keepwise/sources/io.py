"""Sources and sinks A1-A6.

Canonical storage is parquet; CSV stays the raw input format. Written data
goes under a folder the caller names, by default inside the shared
``spark.checkpoint.dir`` of the cluster (never a machine-local temp folder).
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from keepwise import constants as K
from keepwise.operators.descriptive import KPI_VIEWS, kpi_view_sql
from keepwise.session import ensure_checkpoint_dir
from keepwise.sources import splitcsv


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "keepwise-data", *parts])


def tag(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:12]


# --- A1 -----------------------------------------------------------------------

def read_raw_csv(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """A1: read raw subscriber CSV(s) with a header, every column as text.

    No schema inference (a pass over the data, types that depend on it). The
    NA tokens pandas recognises become NULL. Quotes are doubled inside quoted
    fields. A missing path, a row with more or fewer fields than the header and
    a header other than ``columns`` are errors. ``multi_line`` allows line
    breaks inside quotes; files are split all the same (``splitcsv``).
    """
    reader = spark.read.options(header=True, quote='"', escape='"')
    if columns is None:
        columns = reader.option("multiLine", multi_line).csv(path).columns  # the first record of a file
        reader = reader.option("multiLine", False)
    if multi_line:
        return _without_na(splitcsv.read_records(spark, path, columns), columns, F.struct("file", "block", F.col("record").alias("pos")))
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    df = (
        reader.schema(schema)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .option("columnPruning", False)   # else a bad row passes where few columns are read
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return _without_na(df, columns, ingest_order())


def _without_na(df: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """``columns`` with NA tokens as NULL, led by ``ingest_seq`` where they don't have it."""
    cols = [F.when(~F.col(f"`{c}`").isin(*K.CSV_NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in columns]
    if "ingest_seq" not in [c.strip().lower() for c in columns]:
        cols.insert(0, order.alias("ingest_seq"))
    return df.select(*cols)


def ingest_order():
    """Read order of each row across files and splits: (file, split start,
    increasing id). Rows of one split are read in order inside one task, so
    sorting on this key gives file order; the dedupe keeps the first copy."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Write text columns as CSV keeping edge whitespace (for round trips)."""
    (
        df.write.mode("overwrite")
        .options(header=True, quote='"', escape='"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


# --- A2 / A5 ------------------------------------------------------------------

def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A2: the clean table, replaced on each run (parquet; CSV on request)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_clean(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """Read the clean table back; CSV needs the schema (no inference)."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("reading the clean table from CSV needs its schema")
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)


def write_scored(df: DataFrame, path: str) -> None:
    """A5: the scored table, partitioned by risk tier (dashboards that filter by
    tier read only their partitions)."""
    df.write.mode("overwrite").partitionBy("risk_tier").parquet(path)


def read_scored(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


# --- A3 / A4 ------------------------------------------------------------------

def save_fact(df: DataFrame, name: str = "fact_subscriber", path: str | None = None) -> DataFrame:
    """A3: replace the fact table in the session catalog.

    The table is external, under ``path`` (default: a fixed folder of the
    warehouse), so a re-run of any application replaces the same files.
    """
    spark = df.sparkSession
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    df.write.mode("overwrite").option("path", path or f"{warehouse}/keepwise/{name}").saveAsTable(name)
    return spark.table(name)


def register_views(spark: SparkSession, fact: str = "fact_subscriber") -> DataFrame:
    """A4: (re)create the three KPI views; returns their contents in long form.

    The views are stored in the catalog, by the text of the operators' own
    expressions: they outlive the session and follow the fact table. A
    session view of the same name, which would hide the stored one, goes.
    Result: (view_name, subscription_type, region, metric, value), keys null
    where a view has none.
    """
    for name in KPI_VIEWS:
        spark.catalog.dropTempView(name)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS {kpi_view_sql(name, fact)}")
    return view_rows(spark)


def view_rows(spark: SparkSession) -> DataFrame:
    """The contents of the stored views in long form."""
    every, out = ("subscription_type", "region"), None
    for name, (keys, metrics, _) in KPI_VIEWS.items():
        pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        part = spark.table(name).select(
            F.lit(name).alias("view_name"), *[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in every],
            F.inline(F.array(*pairs)))
        out = part if out is None else out.unionByName(part)
    return out


# --- A6 -----------------------------------------------------------------------

METRICS_SCHEMA = StructType([
    StructField("model", StringType()), StructField("split", StringType()),
    StructField("metric", StringType()), StructField("value", DoubleType()),
])


def write_metrics(df: DataFrame, path: str) -> None:
    """The evaluation report as JSON lines of the long metrics table."""
    df.select("model", "split", "metric", "value").write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read the report back; an absent report is an empty table (the reference
    returns an empty dict)."""
    try:
        return spark.read.schema(METRICS_SCHEMA).json(path)
    except Exception as exc:  # noqa: BLE001 - missing path
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], METRICS_SCHEMA)
        raise


REPORT_SCHEMA = StructType([
    StructField("section", StringType()), StructField("name", StringType()),
    StructField("metric", StringType()), StructField("value", DoubleType()),
])


def write_report(df: DataFrame, path: str) -> None:
    """The full evaluation report (H13) as JSON lines, replaced on each run."""
    df.select("section", "name", "metric", "value").write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read the report back with its schema; absent -> empty table."""
    try:
        return spark.read.schema(REPORT_SCHEMA).json(path)
    except Exception as exc:  # noqa: BLE001 - missing path
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], REPORT_SCHEMA)
        raise
