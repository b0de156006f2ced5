"""SimHash near-duplicates by pigeonhole blocks (operator 1).

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. Two fingerprints that differ in at most three bits differ in at most
three of six blocks, so they agree in three whole blocks at least: each
distinct fingerprint goes to the 20 choices of three blocks (32 bits or so),
and only fingerprints that meet there are compared, by Hamming distance.

Links join into components by alternating large-star and small-star rounds on
DataFrames. Copies with equal fingerprints are one node from the start, so a
hot group costs one node; near copies that share a block key are walked as a
breadth-first tree, so a group of m fingerprints yields m - 1 links at most,
never all its pairs. A key with more than ``GROUP`` fingerprints is dealt
again on 48 bits, which leaves 2**16 fingerprints at most to a key.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm.common import map_documents, staged
from keepwise.operators.joins import fresh

BITS = 64
#: fingerprints a block key may hold before it is dealt again on more bits
GROUP = 4096
#: shingles hashed at a time, to bound memory on very long texts
STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority fingerprint (unsigned) of a text's UTF-8 bytes; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), STEP):
        raw = b"".join([digest(line[a:b], 42) for a, b in zip(starts[at:at + STEP], ends[at:at + STEP])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def with_fingerprint(
    docs: DataFrame, shingle: int = 3, text: str = "text", keep: list[str] | None = None, name: str = "fp",
) -> DataFrame:
    """``docs`` with ``name``: the fingerprint as a signed long (null text: zero)."""
    def make():
        def one(raw: bytes) -> tuple:
            value = fingerprint(raw, shingle)
            return (value - (1 << BITS) if value >> (BITS - 1) else value,)
        return one

    return map_documents(docs, make, f"{name} long", text, keep)


def _blocks(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` as ``parts`` masks of nearly equal size."""
    places = [i for i in range(BITS) if mask >> i & 1]
    cut = [round(len(places) * i / parts) for i in range(parts + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cut, cut[1:])]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def block_masks(bits: int) -> list[int]:
    """Masks of which one at least hides every difference of up to ``bits`` bits."""
    blocks = _blocks((1 << BITS) - 1, 2 * bits)
    return [sum(c) for c in combinations(blocks, bits)] if bits else [(1 << BITS) - 1]


def second_masks(mask: int, bits: int) -> list[int]:
    """``mask`` widened by whole blocks of the other bits (half of them)."""
    rest = _blocks(((1 << BITS) - 1) & ~mask, 2 * bits)
    return [mask | sum(c) for c in combinations(rest, bits)]


def _tree(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links of a breadth-first forest over fingerprints within ``bits`` bits."""
    left, right, rest = [], [], fps
    while rest.size:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            node = queue.pop()
            near = np.bitwise_count((rest ^ node).view(np.uint64)) <= bits  # of signed values it counts the absolute one's bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left += [int(node)] * len(found)
                right += found.tolist()
                queue += list(found)
    return left, right


LINKS = "a long, b long, mask long"


def _walk(bits: int, group: int | None):
    """Arrow function over rows (mask, key, fp) sorted by all three.

    Yields links (a, b, null); of a key with more than ``group`` fingerprints,
    the rows themselves as (fp, null, mask), to be dealt again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last, over = 0, None, False

        def out(a, b, mask):
            n = len(a)
            return pa.RecordBatch.from_arrays([
                pa.array(a, pa.int64()), pa.array(b if b is not None else [None] * n, pa.int64()),
                pa.array([mask] * n, pa.int64())], names=["a", "b", "mask"])

        def close():
            nonlocal held, size
            left, right = _tree(np.concatenate(held), bits) if size > 1 and not over else ([], [])
            held, size = [], 0
            return left, right

        for batch in batches:
            mask, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp"))
            if not len(fp):
                continue
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], new])
            ends = np.concatenate([new, [len(fp)]])
            left, right = [], []
            many = ends - starts > 1
            many[0] = many[-1] = True  # may go on in the batch before or after
            for s, e in zip(starts[many].tolist(), ends[many].tolist()):
                here = (mask[s], key[s])
                if here != last:
                    for side, found in zip((left, right), close()):
                        side += found
                    last, over = here, False
                held.append(fp[s:e])
                size += e - s
                if group and (over or size > group):
                    yield out(np.concatenate(held), None, int(mask[s]))
                    held, size, over = [], 0, True
            if left:
                yield out(left, right, None)
        left, right = close()
        if left:
            yield out(left, right, None)

    return run


def _meet(fps: DataFrame, masks, bits: int, group: int | None) -> DataFrame:
    """Fingerprints dealt to their keys under ``masks`` (an array column) and compared."""
    keyed = fps.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return (keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
            .mapInArrow(_walk(bits, group), LINKS))


def links(fps: DataFrame, bits: int = 3, group: int = GROUP) -> DataFrame:
    """(a, b): links within ``bits`` bits that connect all of distinct ``fp``."""
    spark = fps.sparkSession
    if not bits:
        return spark.range(0).selectExpr("id AS a", "id AS b")
    first = staged(_meet(fps, F.array(*[F.lit(_signed(m)) for m in block_masks(bits)]), bits, group), "links")
    deferred = first.where("b IS NULL")
    found = first.where("b IS NOT NULL").select("a", "b")
    if deferred.isEmpty():
        return found.distinct()
    wider = F.create_map(*[
        part for m in block_masks(bits)
        for part in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in second_masks(m, bits)]))])
    again = _meet(deferred.select(F.col("a").alias("fp"), "mask"), wider[F.col("mask")], bits, None)
    return found.union(again.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph, root the smallest node of its component.

    Nodes without edges do not appear. Alternates large-star and small-star
    until the edges no longer change; every round is staged, and so are the
    minima: an aggregate's side of a join is one that Spark cannot split at a
    hub with most of the edges.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = staged(small, "edges")


def classes(prints: DataFrame, doc_id: str = "doc_id", bits: int = 3) -> DataFrame:
    """(fp, root, component_id) of every distinct ``fp`` in ``prints``.

    ``root`` is the component's smallest fingerprint (signed order) and
    ``component_id`` its smallest id; null ids count only where a component
    has no other (then null).
    """
    fps = staged(prints.groupBy("fp").agg(F.min(doc_id).alias("first")), "fps")
    comp = staged(components(links(fps.select("fp"), bits)), "components")
    rooted = staged(fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    ids = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    return rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp, root), a row per row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other;
    repeated rows each give a row; an empty table gives no row.
    """
    prints = staged(with_fingerprint(docs, shingle, text, [doc_id]), "prints")
    label = classes(prints, doc_id, bits)
    return prints.join(label, "fp").select(
        doc_id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp", "root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one document.

    The row with the smallest id stays (ids missing: last), the smaller
    fingerprint on ties; of rows that agree in both, the smallest by all
    columns that have an order, so repeated rows leave one.
    """
    groups = near_duplicates(docs, doc_id, text, shingle, bits)
    rank = F.struct(F.col(doc_id).isNull(), F.col(doc_id).alias("id"), F.col("fp"))
    kept_id, kept_fp, own, n = (fresh(x, docs.columns) for x in ("__id", "__fp", "__own", "__n"))
    keep = groups.groupBy("root").agg(F.min(rank).alias("k")).select(F.col("k.id").alias(kept_id), F.col("k.fp").alias(kept_fp))
    marked = with_fingerprint(docs, shingle, text, name=own)
    out = marked.join(keep, F.col(doc_id).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_fp)), "left_semi")
    ordered = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    w = Window.partitionBy(doc_id, own).orderBy(*ordered)
    return out.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).select(*docs.columns)
