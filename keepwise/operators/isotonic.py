"""Isotonic regression by merging lower hulls, range by range.

The monotone fit of labels on scores is the slope of the greatest convex
minorant of the cumulative sums: its blocks lie between the vertices of the
lower hull of the points (rows so far, labels so far). Scores are dealt to
ranges of a bounded size; each range's task keeps its own hull. Neighbouring
ranges then merge, pairs of a level at once, until one is left: the bridge
between two hulls is found by turns (the lowest slope from a left vertex, the
highest to a right one), each turn one aggregate over all pairs, and what lies
over the bridge goes. Vertices stay in a table; the driver holds a row a range.

Without any pooling the table has a row per distinct score, and no task or
driver ever holds it whole.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.functions.places import numbers, place
from keepwise.functions.staging import staged
from keepwise.operators.joins import asof_join, fresh

#: distinct scores of a range
RANGE_ROWS = 100_000
#: blocks up to which a fit is a constant of the expression that applies it (1 MB); a larger one is joined
SENT_BLOCKS = 20_000
VERTEX = "range int, rows double, total double, score double, following double"
BLOCK = "lo double, hi double, fitted double, next_lo double, next_fitted double"


@dataclass
class Isotonic:
    """A monotone step fit: a table of blocks (lo, hi, fitted) and, of each, the next one's lo and fitted value."""
    blocks: DataFrame
    count: int
    _sent: object = field(default=None, repr=False, compare=False)

    def transform(self, df: DataFrame, score: str, out: str) -> DataFrame:
        """``df`` with the fitted value of ``score``: interpolated between
        blocks, that of the end block outside, null for a null score or an
        empty fit."""
        x = F.col(score).cast("double")
        known = x.isNotNull() & ~F.isnan(x)
        if self.count == 0:
            return df.withColumn(out, F.lit(None).cast("double"))
        if self.count > SENT_BLOCKS:
            first = self.blocks.orderBy("lo").first()["fitted"]
            found = asof_join(df, self.blocks, score, "lo", suffix="__iso")
            lo, hi, fitted, next_lo, next_fitted = (F.col(f"{c}__iso") for c in ("lo", "hi", "fitted", "next_lo", "next_fitted"))
            value = F.when(known & lo.isNull(), F.lit(first)).when(known, _between(x, hi, fitted, next_lo, next_fitted))
            return found.withColumn(out, value).select(*df.columns, out)
        if self._sent is None:  # SENT_BLOCKS at most
            self._sent = [list(c) for c in zip(*self.blocks.select("lo", "hi", "fitted").orderBy("lo").collect())]
        at = fresh("__at", [*df.columns, out])
        lo, hi, fitted = (numbers(c) for c in self._sent)
        i = F.col(at)
        value = F.when(known & (i == 0), F.get(fitted, F.lit(0))).when(
            known, _between(x, F.get(hi, i - 1), F.get(fitted, i - 1), F.get(lo, i), F.get(fitted, i)))
        return df.withColumn(at, place(x, self._sent[0])).withColumn(out, value).select(*df.columns, out)

    def save(self, path: str) -> None:
        self.blocks.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Isotonic:
        blocks = spark.read.schema(BLOCK).parquet(path)
        return cls(blocks, blocks.count())


def _between(x: Column, hi: Column, fitted: Column, next_lo: Column, next_fitted: Column) -> Column:
    """The value at x, which is not below the block that ends at ``hi`` and below the next one."""
    return F.when((x <= hi) | next_lo.isNull(), fitted).otherwise(fitted + (next_fitted - fitted) * (x - hi) / (next_lo - hi))


def fit_isotonic(df: DataFrame, score: str = "p", label: str = "label", range_rows: int | None = None) -> Isotonic:
    """The monotone fit of ``label`` on ``score``; rows of one score are one
    weighted point, rows with a null or NaN in either are left out."""
    spark = df.sparkSession
    range_rows = RANGE_ROWS if range_rows is None else range_rows
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    known = df.select(x.alias("score"), y.alias("label")).where("score IS NOT NULL AND label IS NOT NULL AND NOT isnan(score) AND NOT isnan(label)")
    points = staged(known.groupBy("score").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("total")), "iso-points")
    parts = max(1, -(-points.count() // range_rows))
    dealt = staged(points.repartitionByRange(parts, "score").withColumn("range", F.spark_partition_id()), "iso-ranges")
    sums = dealt.groupBy("range").agg(F.min("score").alias("first"), F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("range").collect()
    if not sums:
        return Isotonic(spark.createDataFrame([], BLOCK), 0)
    firsts = [r["first"] for r in sums[1:]] + [None]
    before, at = {}, (0.0, 0.0)
    for i, (r, following) in enumerate(zip(sums, firsts)):
        before[r["range"]] = (i, *at, following)
        at = (at[0] + r["n"], at[1] + r["total"])

    def own_hull(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number, rows0, total0, following = before[key[0]]
        pdf = pdf.sort_values("score")
        rows, total = rows0 + pdf["n"].cumsum().to_numpy(), total0 + pdf["total"].cumsum().to_numpy()
        score = pdf["score"].to_numpy()
        after = np.append(score[1:], np.nan if following is None else following)
        # the point before the range counts for its hull but belongs to the range before
        keep = _hull(np.append(rows0, rows), np.append(total0, total))[1:] - 1
        return pd.DataFrame({"range": number, "rows": rows[keep], "total": total[keep], "score": score[keep], "following": after[keep]})

    hull = staged(dealt.groupBy("range").applyInPandas(own_hull, VERTEX), "iso-hull")
    hull = _merged(hull, len(sums))
    blocks = staged(_blocks(hull, sums[0]["first"], len(sums)), "iso-blocks")
    return Isotonic(blocks, blocks.count())


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the lower hull's vertices of points in ascending x; points on an edge are none."""
    kept: list[int] = []
    xs, ys = x.tolist(), y.tolist()
    for i in range(len(xs)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (ys[b] - ys[a]) * (xs[i] - xs[b]) < (ys[i] - ys[b]) * (xs[b] - xs[a]):
                break
            kept.pop()
        kept.append(i)
    return np.array(kept)


def _merged(hull: DataFrame, ranges: int) -> DataFrame:
    """The hull of all ranges: neighbours merge level by level."""
    width = 1
    while width < ranges:
        pair = F.floor(F.col("range") / (2 * width)).cast("int")
        right = F.floor(F.col("range") / width) % 2 == 1
        sides = hull.select(pair.alias("pair"), right.alias("right"), "rows", "total")
        # the left hull ends where the right one starts; the first one starts at the origin
        ends = sides.where(~F.col("right")).groupBy("pair").agg(F.max(F.struct("rows", "total")).alias("v")).collect()
        bridged = {r["pair"] for r in sides.where("right").select("pair").distinct().collect()}
        left_at = {r["pair"]: tuple(r["v"]) for r in ends if r["pair"] in bridged}
        right_at: dict[int, tuple[float, float]] = {}
        while True:
            new_right = _touch(sides.where("right"), left_at, lowest=True)
            new_left = _touch(sides.where(~F.col("right")), new_right, lowest=False, origin=0)
            if (new_left, new_right) == (left_at, right_at):
                break
            left_at, right_at = new_left, new_right
        if left_at:
            low = F.create_map(*[F.lit(v) for p, at in left_at.items() for v in (p, at[0])])
            high = F.create_map(*[F.lit(v) for p, at in right_at.items() for v in (p, at[0])])
            over = F.coalesce((F.col("rows") > low[pair]) & (F.col("rows") < high[pair]), F.lit(False))
            hull = staged(hull.where(~over), "iso-hull")
        width *= 2
    return hull


def _touch(side: DataFrame, others: dict[int, tuple[float, float]], lowest: bool, origin: int | None = None) -> dict[int, tuple[float, float]]:
    """Per pair the vertex of one side where a line from the other side's vertex touches its hull.

    ``origin``: the pair whose left hull starts at (0, 0), which is no row.
    """
    x, y = (F.create_map(*[F.lit(v) for p, at in others.items() for v in (p, at[i])])[F.col("pair")] for i in (0, 1))
    slope = (F.col("total") - y) / (F.col("rows") - x)
    vertex = F.struct("rows", "total")
    # of equal slopes the vertex farther from the other side
    pick = F.min(F.struct(slope.alias("s"), (-F.col("rows")).alias("far"), vertex.alias("v"))) if lowest else F.max(
        F.struct(slope.alias("s"), (-F.col("rows")).alias("far"), vertex.alias("v")))
    found = {r["pair"]: (r["b"]["s"], tuple(r["b"]["v"])) for r in side.where(F.col("pair").isin(*others)).groupBy("pair").agg(pick.alias("b")).collect()}
    if origin in others:
        rows, total = others[origin]
        if origin not in found or total / rows >= found[origin][0]:
            found[origin] = (0.0, (0.0, 0.0))
    return {p: v for p, (_, v) in found.items()}


def _blocks(hull: DataFrame, first: float, ranges: int) -> DataFrame:
    """The blocks between neighbouring vertices; a row per range tells what lies beyond it."""
    ends = {r["range"]: r for r in hull.groupBy("range").agg(
        F.min(F.struct("rows", "total")).alias("low"), F.max(F.struct("rows", "total", "following")).alias("high")).collect()}
    before, at = {}, (0.0, 0.0, first)
    for r in sorted(ends):
        before[r] = at
        at = tuple(ends[r]["high"])
    after = dict(zip(sorted(ends), [tuple(ends[r]["low"]) for r in sorted(ends)][1:]))

    def own_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rows")
        rows0, total0, lo0 = before[key[0]]
        rows, total = np.append(rows0, pdf["rows"]), np.append(total0, pdf["total"])
        fitted = np.diff(total) / np.diff(rows)
        following = pdf["following"].to_numpy()
        last = np.nan
        if key[0] in after:
            rows1, total1 = after[key[0]]
            last = (total1 - total[-1]) / (rows1 - rows[-1])
        return pd.DataFrame({"lo": np.append(lo0, following[:-1]), "hi": pdf["score"].to_numpy(), "fitted": fitted, "next_lo": following,
                             "next_fitted": np.append(fitted[1:], last)})

    out = hull.groupBy("range").applyInPandas(own_blocks, BLOCK)
    last = F.isnan("next_lo") | F.isnan("next_fitted")
    return out.withColumns({c: F.when(last, None).otherwise(F.col(c)) for c in ("next_lo", "next_fitted")})
