"""Splittable CSV with line breaks inside quotes.

A split of a file cannot tell by itself whether it starts inside a quoted
field. Whether it does is the parity of the quotes before it, and parity adds
up: a first pass counts the quotes of each split, a prefix over the splits of
a file gives each its state. The second pass then puts lines together in the
order in which each split holds them. A record of one line, which is nearly
all, goes straight on; only lines of longer records are shuffled, and the
lines that a split starts with inside a record find it through a table of a
row per split.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "value string, file string, block long"
PIECE = "file string, block long, record long, line long, value string, whole boolean, open boolean"
#: record number of lines that belong to a record of an earlier split
HEAD = -1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files in read order, each with its file and the start of its split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _pieces(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """Each line with its record, in one pass over the splits.

    ``whole``: the line is a record of its own; ``open``: the line is the last
    of its split and its record goes on.
    """
    sent = lines.sparkSession.sparkContext.broadcast(inside)  # the splits that start inside quotes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, record, line, held = None, HEAD, 0, None
        out: list[tuple] = []
        within = False
        for batch in batches:
            for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
                if (file, block) != at:
                    if held:
                        out.append((*held, True))
                        held = None
                    at, within, record, line, following = (file, block), (file, block) in sent.value, HEAD, 0, 0
                if held:  # the line before, whose record goes on here
                    out.append((*held, False))
                    held = None
                odd = value.count('"') % 2 == 1
                if not within:
                    record, line = following, 0
                    following += 1
                if odd:
                    within = not within
                piece = (file, block, record, line, value, record != HEAD and line == 0 and not within)
                line += 1
                if within:
                    held = piece
                else:
                    out.append((*piece, False))
            yield _batch(out)
            out = []
        if held:
            yield _batch([(*held, True)])

    return lines.mapInArrow(run, PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [("file", pa.string()), ("block", pa.int64()), ("record", pa.int64()), ("line", pa.int64()), ("value", pa.string()),
             ("whole", pa.bool_()), ("open", pa.bool_())]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, record, value): the records of CSV files with their place, quoted line breaks kept.

    ``block`` is the start of the split where a record starts, ``record`` its
    number there, so both order the records of a file. Quotes stand for
    themselves only doubled within quotes. An end of file inside quotes ends
    the record.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    splits = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = splits.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    inside = {(r["file"], r["block"]) for r in states.where("inside").collect()}  # at most a row per split
    pieces = _pieces(lines, inside)
    single = pieces.where("whole").select("file", "block", "record", "value")
    if not inside and pieces.where("NOT whole").isEmpty():
        return single
    parts = pieces.where("NOT whole")
    # the record that a split leaves open, carried over splits that lie inside it
    left = parts.where("open").where(F.col("record") != HEAD).groupBy("file", "block").agg(F.max("record").alias("record"))
    ends = states.join(left, ["file", "block"], "left").select("file", "block", F.when(
        F.col("record").isNotNull(), F.struct(F.col("block").alias("block"), F.col("record").alias("record"))).alias("end"))
    owner = ends.select("file", "block", F.last("end", ignorenulls=True).over(before).alias("owner"))
    head = F.col("record") == HEAD
    owned = parts.join(owner, ["file", "block"], "left").select(
        "file", F.when(head, F.col("owner.block")).otherwise(F.col("block")).alias("of_block"),
        F.when(head, F.col("owner.record")).otherwise(F.col("record")).alias("of_record"), F.struct("block", "line", "value").alias("piece"))
    joined = owned.groupBy("file", "of_block", "of_record").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["value"]), "\n")
    return single.unionByName(joined.select("file", F.col("of_block").alias("block"), F.col("of_record").alias("record"), text.alias("value")))


def read_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``columns`` as text, then file, block and record, of all records but each file's first, its header.

    A header other than ``columns`` and a record with more or fewer fields are
    errors; empty lines are no records.
    """
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{n} string" for n in names)
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    found = records(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    parsed = found.where("value <> ''").select("file", "block", "record", F.from_csv("value", F.lit(schema), options).alias("row"))
    fields = F.array(*[F.coalesce(F.col(f"row.{n}"), F.lit("")) for n in names])
    wanted = F.array(*[F.lit(c) for c in columns])
    is_header = (F.col("block") == 0) & (F.col("record") == 0)
    wrong = F.raise_error(F.concat(F.lit("the header is not that of the columns: "), F.array_join(fields, ",")))
    checked = F.when(is_header, F.when(fields == wanted, F.lit(False)).otherwise(wrong.cast("boolean"))).otherwise(F.lit(True))
    return parsed.where(checked).select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, columns)], "file", "block", "record")
