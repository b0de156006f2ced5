"""Mixing sources to target weights (operator 7).

Capped water-filling: sources share a total by weight, a source stops at its
maximum number of epochs, and what it can't take is shared by the others by
weight until none is above its cap. A source's epochs are then whole
repetitions of all its rows and one seeded sample for the fraction.

The sample takes rows in the order of a seeded hash up to the fraction, and
in place of the row at the edge the one row behind it whose size closes the
gap best. Sizes are summed per source and hash bucket first, so rows are
ordered only within one of 65,536 buckets, whatever a source's share, and
running sums go over 256 groups of buckets, then 256 buckets of one group.
"""
from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm.common import WORD, dense_index, staged
from keepwise.operators.joins import fresh

WEIGHTS = (5, 2, 1)
_WIDE = "decimal(38,0)"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: Fraction, epochs: int) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: their capped shares of ``budget`` times all sizes.

    Each round computes one level from exact sums over the sources not yet at
    their cap (target = level * weight) and caps those above; the level only
    rises, so rounds end with the last source to be capped.
    """
    sources = staged(sources, "sources")
    s, w = F.col("source_size").cast(_WIDE), F.col("weight").cast(_WIDE)
    total = sources.agg(F.sum(s)).first()[0]
    if total is None:
        return sources.withColumn("target", F.lit(0.0))
    level = None
    while True:
        capped = F.lit(False) if level is None else _above(s, w, level, epochs)
        caps, weights = sources.agg(F.sum(F.when(capped, s)), F.sum(F.when(~capped, w))).first()
        if not weights:
            break
        now = (budget * int(total) - epochs * int(caps or 0)) / int(weights)
        if now == level:
            break
        level = now
    shared = F.lit(float(level)) * F.col("weight")
    return sources.withColumn("target", F.when(_above(s, w, level, epochs), (epochs * F.col("source_size")).cast("double")).otherwise(shared))


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast(_WIDE)


def _above(size: Column, weight: Column, level: Fraction, epochs: int) -> Column:
    """Whether the level's share is at or over the cap, in whole numbers."""
    return _whole(level.numerator) * weight >= _whole(epochs * level.denominator) * size


def plan(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", budget: Fraction = Fraction(3, 2),
         epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): the narrow staged rows and how each source is taken.

    rows: doc_id, source, size, bucket, and the sampling key (order, doc_id).
    sources: source_size, weight, target, whole repetitions, and the sample as
    ``cut`` (the last key taken, null: none) and ``extra`` (one more key).
    """
    order = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    rows = staged(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), order.alias("order"),
    ).withColumn("bucket", F.shiftrightunsigned("order", 48).cast("int")), "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_index(sums, [F.col("source").asc_nulls_last()], "place")
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    filled = water_fill(weighed, budget, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = staged(filled.withColumn("whole", whole).withColumn(
        "need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "targets")
    return rows, staged(_sample(rows, sources), "mix-plan")


def _key(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}bucket").alias("bucket"), F.col(f"{prefix}order").alias("order"))


def _edge(groups: DataFrame, key: str, needs: DataFrame) -> DataFrame:
    """(source, need, key, before): the group of each source in which its need ends.

    groups: (source, key, size); needs: (source, need, before), the words
    before its first group.
    """
    upto = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = (groups.alias("a").join(needs.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
              .select("a.source", "a.size", f"a.{key}", "b.need", "b.before")
              .withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0))))
    return summed.where("before <= need AND need < before + size").select("source", "need", key, "before")


def _sample(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with cut and extra.

    The edge is found in 256 coarse groups of buckets, then among the 256
    buckets of one group, so a running sum has 256 rows a source at most.
    """
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    needs = sources.where("need > 0").select("source", "need", F.lit(0).cast("long").alias("before"))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")).withColumn("coarse", F.shiftright("bucket", 8))
    coarse = _edge(rows.groupBy("source", F.shiftright("bucket", 8).alias("coarse")).agg(F.sum("size").alias("size")), "coarse", needs)
    inner = buckets.alias("a").join(coarse.alias("b"), same & (F.col("a.coarse") == F.col("b.coarse"))).select("a.source", "a.bucket", "a.size")
    edge = staged(_edge(inner, "bucket", coarse.select("source", "need", "before")), "mix-edge")
    keys = rows.alias("a").join(edge.alias("b"), same & (F.col("a.bucket") == F.col("b.bucket"))).groupBy(
        F.col("a.source").alias("source"), "a.bucket", "order").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("need").alias("need"))
    upto = Window.partitionBy("source").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    taken = keys.withColumn("sum", F.col("before") + F.sum("size").over(upto))
    cut = taken.where("sum <= need").groupBy("source").agg(F.max(_key()).alias("cut"), F.max("sum").alias("sum"))
    inside = edge.alias("a").join(cut.alias("b"), same, "left").select(
        F.col("a.source").alias("source"),
        F.coalesce(F.col("b.cut"), F.struct((F.col("a.bucket") - 1).alias("bucket"), F.lit((1 << 63) - 1).alias("order"))).alias("cut"),
        (F.col("a.need") - F.coalesce(F.col("b.sum"), F.col("a.before"))).alias("gap"))
    behind = rows.alias("a").join(inside.alias("b"), same).where(_key("a.") > F.col("b.cut")).groupBy(
        F.col("a.source").alias("source"), "a.bucket", "a.order").agg(F.sum("a.size").alias("size"), F.first("b.gap").alias("gap"))
    extra = behind.where(F.abs(F.col("gap") - F.col("size")) < F.col("gap")).groupBy("source").agg(
        F.min_by(_key(), F.struct(F.abs(F.col("gap") - F.col("size")), "bucket", "order")).alias("extra"))
    found = inside.alias("a").join(extra.alias("b"), same, "left").select(F.col("a.source").alias("source"), "cut", "extra")
    return sources.alias("a").join(found.alias("b"), same, "left").select("a.*", "b.cut", "b.extra")


def repetitions(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` joined to their source's plan, with ``times``: how often the mix takes a row."""
    # xxhash64's order is signed, the bucket's unsigned: within a bucket both agree
    key = _key("a.")
    more = F.coalesce(key <= F.col("b.cut"), F.lit(False)) | F.coalesce(key == F.col("b.extra"), F.lit(False))
    joined = rows.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    return joined.select("a.*", F.col("b.source_size"), F.col("b.target"), (F.col("b.whole") + more.cast("long")).alias("times"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken), a row per row of ``docs``.

    Null texts have size 0, a null source is a source, last in order. Rows
    equal in id and text are taken alike. Sources without words get whole
    repetitions 0. An empty table gives no row.
    """
    rows, sources = plan(docs, source, text, doc_id, **options)
    return repetitions(rows, sources).select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def repeat(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = 7, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    _, sources = plan(docs, source, text, doc_id, seed=seed, **options)
    order = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    key = F.struct(F.shiftrightunsigned(order, 48).cast("int").alias("bucket"), order.alias("order"))
    more = F.coalesce(key <= F.col("__b.cut"), F.lit(False)) | F.coalesce(key == F.col("__b.extra"), F.lit(False))
    small = sources.select(F.col("source").alias("source"), "whole", "cut", "extra").alias("__b")
    joined = docs.alias("__a").join(small, F.col(f"__a.{source}").eqNullSafe(F.col("__b.source")))
    times = (F.col("__b.whole") + more.cast("long")).cast("int")
    copy = fresh("__copy", docs.columns)
    return joined.select("__a.*", F.explode(F.array_repeat(F.lit(1), times)).alias(copy)).drop(copy)
