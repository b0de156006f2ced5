"""Exact top-k search by multi-resolution segment statistics (operator 9).

Vectors become integers. An orthonormal rotation fitted on a block's queries
gathers their energy in the first dimensions; inner products stay. At each
resolution a rotated vector is some segments with a mean and a deviation each;
for a query q and a vector x, the squared distance is at least the sum of
(segment length) * ((mean difference)^2 + (deviation difference)^2), so with
both norms the inner product is at most the sum of length * (mean * mean +
deviation * deviation). Resolutions go from segments of 16 down to pairs, the
last splits the first half into single dimensions. From coarse to fine, pairs
whose bound is under the query's k-th best score so far drop out, and a
resolution is evaluated for survivors only. Survivors get their exact integer
score in the order of their last bound, so that the first raise the limit for
the rest.

Queries are held in blocks of bounded bytes. Each vector is dealt to one cell
of every block; a cell streams its vectors past the block, a tile of queries
and a tile of vectors at a time.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm.common import staged

#: bytes of a block of queries; about five times as much is held
BLOCK_BYTES = 64 << 20
#: vectors a cell streams, about
CELL_ROWS = 1 << 20
#: queries and vectors compared at a time
TILE = 1024
#: smallest limit
NONE = -(2**63)


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def edges_of(dim: int, size: int, split: int = 0) -> np.ndarray:
    """Starts of segments of ``size`` dimensions, the first ``split`` dimensions single; ``dim`` closes them."""
    return np.array([*range(min(split, dim)), *range(min(split, dim), dim, size), dim])


def resolutions(dim: int) -> list[np.ndarray]:
    """Segment edges, coarse to fine; each refines the one before."""
    half = dim // 2 // 2 * 2
    levels = [edges_of(dim, s) for s in (16, 8, 4, 2) if s < 2 * dim] + [edges_of(dim, 2, half)] * bool(half)
    return levels if dim else []


def segment_stats(m: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows (sqrt(length) * mean, sqrt(length) * deviation) per segment: their dot product bounds the rows'."""
    length = np.diff(edges)
    sums = np.add.reduceat(m, edges[:-1], axis=1)
    squares = np.add.reduceat(m * m, edges[:-1], axis=1)
    mean = sums / length
    wide = length > 1  # a single dimension has no deviation
    spread = np.sqrt(np.maximum(squares / length - mean * mean, 0))[:, wide]
    return np.hstack([mean * np.sqrt(length), spread * np.sqrt(length[wide])])


def rotation(m: np.ndarray) -> np.ndarray:
    """Orthonormal axes of the rows of ``m``, the one with most energy first."""
    return np.linalg.eigh(m.T @ m)[1][:, ::-1]


class Block:
    """Queries of one dimension with their k best so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.ids, self.vectors, self.k = rows, ids, vectors, k
        self.levels = resolutions(vectors.shape[1])
        real = vectors.astype(float)
        self.most = np.abs(real).max(initial=0)
        if self.levels:
            self.axes = rotation(real / max(1.0, self.most))
            real = real @ self.axes
        self.stats = [segment_stats(real, e) for e in self.levels]
        self.score = np.full((len(ids), k), NONE, np.int64)
        self.found = np.full((len(ids), k), 2**63 - 1, np.int64)
        self.filled = np.zeros((len(ids), k), bool)
        self.pairs = self.exact_pairs = 0
        self.level_pairs = [0] * len(self.levels)

    def offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Compares every query with these vectors; a query's own row is none of its candidates."""
        if not len(ids):
            return
        real = vectors.astype(float)
        most = self.most * np.abs(real).max(initial=0) * max(1, vectors.shape[1])
        if most >= 2**62:
            raise OverflowError("scores don't fit a long")
        slack = most * 1e-9 + 1e-6  # more than rounding can take off a bound
        if self.levels:
            real = real @ self.axes
        stats = [segment_stats(real, e) for e in self.levels]
        for at in range(0, len(self.ids), TILE):
            self._tile(at, min(at + TILE, len(self.ids)), rows, ids, vectors, stats, slack)

    def _tile(self, first: int, end: int, rows, ids, vectors, stats, slack: float) -> None:
        limit = np.where(self.filled[first:end, -1], self.score[first:end, -1], NONE).astype(float)
        alive = self.rows[first:end, None] != rows[None, :]
        self.pairs += int(alive.sum())
        bounds, level = np.zeros(alive.shape), 0
        while level < len(stats):  # as long as no pair has dropped out, all at once
            self.level_pairs[level] += int(alive.sum())
            bounds = self.stats[level][first:end] @ stats[level].T + slack
            over = bounds >= limit[:, None]
            level += 1
            if not over.all():
                alive &= over
                break
        for q in np.flatnonzero(alive.any(axis=1)):
            self._query(first + q, np.flatnonzero(alive[q]), bounds[q], level, ids, vectors, stats, slack)

    def _query(self, q: int, c: np.ndarray, bounds: np.ndarray, level: int, ids, vectors, stats, slack: float) -> None:
        """The rest of the levels and the exact scores of one query's survivors ``c``."""
        bounds = bounds[c]
        for n in range(level, len(stats)):
            self.level_pairs[n] += len(c)
            bounds = stats[n][c] @ self.stats[n][q] + slack
            if self.filled[q, -1]:
                keep = bounds >= self.score[q, -1]
                c, bounds = c[keep], bounds[keep]
                if not len(c):
                    return
        order = np.argsort(-bounds, kind="stable")
        c, bounds = c[order], bounds[order]
        at, step = 0, 4 * self.k
        while at < len(c):
            if self.filled[q, -1]:
                c = c[:np.searchsorted(-bounds, -float(self.score[q, -1]), side="right")]
                bounds = bounds[:len(c)]
            self._take(q, ids[c[at:at + step]], vectors[c[at:at + step]])
            at, step = at + step, 2 * step

    def _take(self, q: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Exact scores of some candidates, merged into the best."""
        exact = vectors @ self.vectors[q]
        self.exact_pairs += len(ids)
        if self.filled[q, -1]:
            better = exact >= self.score[q, -1]
            exact, ids = exact[better], ids[better]
        have = self.filled[q]
        score, found = np.concatenate([self.score[q, have], exact]), np.concatenate([self.found[q, have], ids])
        order = np.lexsort((found, ~score))[:self.k]  # ~s falls as s rises, without overflow
        self.score[q, :len(order)], self.found[q, :len(order)], self.filled[q, :len(order)] = score[order], found[order], True

    def rows_out(self):
        """(query row, query id, vector id, score) of the best so far."""
        q, _ = np.nonzero(self.filled)
        return self.rows[q], self.ids[q], self.found[self.filled], self.score[self.filled]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cell, held = None, None, []

        def out():
            rows, ids, found, score = block.rows_out()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rows, ids, found, score)], names=["qrow", "query_id", "vec_id", "score"])

        def matrix(part):
            column = part.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(len(column), -1)

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "block", "cell", "kind")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                here, kind, part = tuple(keys[:3, a].tolist()), int(keys[3, a]), batch.slice(a, b - a)
                if here != cell:
                    if block is not None:
                        yield out()
                    cell, block, held = here, None, []
                rows, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id"))
                vectors = matrix(part)
                if not kind:
                    held.append((rows, ids, vectors))
                    continue
                if not held and block is None:
                    continue  # no query has this dimension
                if block is None:
                    block, held = Block(*(np.concatenate(c) for c in zip(*held)), k), []
                for at in range(0, len(ids), TILE):
                    block.offer(rows[at:at + TILE], ids[at:at + TILE], vectors[at:at + TILE])
        if block is not None:
            yield out()

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row.

    Candidates are all rows of the query's dimension but the query's own row
    (another row with the same id is one); ties go to the smaller id. Rows
    without an id, without a vector, or with a null or non-finite component
    take no part. Each row that meets ``queries`` is a query of its own; fewer
    candidates give fewer ranks, an empty table none.
    """
    spark = vectors.sparkSession
    rows = staged(
        vectors.select(F.col(vec_id).cast("long").alias("id"), integers(vector, scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("query"))
        .where("id IS NOT NULL AND vector IS NOT NULL").withColumn("dim", F.size("vector")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries, dim = rows.agg(F.count(F.lit(1)), F.sum(F.col("query").cast("long")), F.max("dim")).first()
    blocks = max(1, -(-(n_queries or 0) * max(1, dim or 1) * 8 // BLOCK_BYTES))
    cells = max(1, -(-n // CELL_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // TILE)))
    at = F.shiftrightunsigned("row", 33) + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))  # round robin over files and rows
    block, cell = F.pmod(at, F.lit(blocks)).cast("int"), F.pmod(at, F.lit(cells)).cast("int")
    asked = rows.where("query").select("dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(0).alias("kind"), "row", "id", "vector")
    offered = rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), cell.alias("cell"), F.lit(1).alias("kind"), "row", "id", "vector")
    found = (asked.union(offered).repartition(blocks * cells, "dim", "block", "cell").sortWithinPartitions("dim", "block", "cell", "kind")
             .mapInArrow(_search(k), "qrow long, query_id long, vec_id long, score long"))
    w = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
