"""Helpers shared by the training-data operators."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.session import ensure_checkpoint_dir

#: a word: a run of characters that are not ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names for checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/keepwise/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: what reads the result finds its rows in files that every
    executor sees, so a lost executor costs a re-read and no recomputation,
    and two readers see the same rows.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """The UTF-8 bytes of a string column (a cast, no copy of the text)."""
    return (F.col(col) if isinstance(col, str) else col).cast("binary")


def map_documents(
    df: DataFrame,
    make: Callable[[], Callable[[bytes], tuple]],
    fields: str,
    text: str = "text",
    keep: list[str] | None = None,
    batch_bytes: int = 8 << 20,
) -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields`` computed from each whole text.

    ``make()`` runs once per task and returns the function applied to each
    text's UTF-8 bytes (null: empty); it returns one value per field. New
    columns replace kept ones of the same name. Texts travel as Arrow batches
    and results leave in batches of at most about ``batch_bytes`` of text.
    """
    new = T._parse_datatype_string(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    out = T.StructType([df.schema[c] for c in kept] + new.fields)
    names = new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new.fields]
        apply = make()
        for batch in batches:
            for part in in_slices(batch, source, batch_bytes):
                rows = [apply(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column(source)]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(c, t) for c, t in zip(columns, types)],
                    names=kept + names,
                )

    source = text if text in kept else "__text"
    return df.select(*kept, *[utf8(text).alias(source)] * (source not in kept)).mapInArrow(run, out)


def in_slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose ``column`` holds about ``size`` bytes (a row at least)."""
    start, total = 0, 0
    for i, value in enumerate(batch.column(column)):
        total += value.as_buffer().size if value.is_valid else 0
        if total >= size:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def numbers(spark: SparkSession, values: list[int]) -> DataFrame:
    """(pos, value) of a short list of fixed integers, built by the JVM from one literal."""
    text = F.split(F.lit(",".join(map(str, values))), ",")
    return spark.range(1).select(F.posexplode(text).alias("pos", "value")).select(
        "pos", F.col("value").cast("int").alias("value"))


def dense_index(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: its row's place (from 0) in the order of ``keys``.

    Rows are range-partitioned and sorted; only one count per partition meets,
    so no task sees all rows. The sorted rows are staged, because the range
    bounds come from a sample.
    """
    spark = df.sparkSession
    low = F.lit((1 << 33) - 1)
    mid = F.monotonically_increasing_id()
    ordered = staged(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("__part", F.shiftright(mid, 33)).withColumn("__at", mid.bitwiseAND(low)),
        name,
    )
    sizes = sorted(ordered.groupBy("__part").count().collect())  # a row per partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    if not starts:
        return ordered.withColumn(name, F.col("__at")).drop("__part", "__at")
    offset = F.element_at(F.create_map(*[F.lit(v) for pair in starts for v in pair]), F.col("__part"))
    return ordered.withColumn(name, offset.cast("long") + F.col("__at")).drop("__part", "__at")
