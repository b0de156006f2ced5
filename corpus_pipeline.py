"""A corpus pipeline: documents in, packed training sequences out.

Toxic documents go, one document of each near-duplicate group stays, secrets
are replaced, sources are mixed to target weights, and what is left is packed.
Each stage calls one operator on all rows its predecessor kept; stages before
the last return the columns of ``documents``. Null, empty and repeated rows
are treated as the operators' docstrings say; an empty table gives no row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.llm import mixing, packing, secret_scan, simhash, toxicity
from keepwise.llm.common import read_table, staged
from keepwise.llm.queries import TOKENIZER, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.7 or more."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), held_out=held_out())
    return toxicity.reject(docs, model, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of fingerprints within three bits."""
    return simhash.one_of_each(docs, shingle=3, bits=3)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    size = F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", size).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources come near their target weights."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, one document each."""
    return packing.pack(docs, TOKENIZER, context=4096, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", replace_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: learned scores, XXH64 fingerprints and tokenizer ids have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
