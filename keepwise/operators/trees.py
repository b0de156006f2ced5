"""What the tree ensembles share: binned features, blocks of training rows, fitted trees.

A numeric feature has the bins between its quantiles, a category a bin per
value; bin 0 stands for a missing number and for a missing or unseen value. A
split asks ``bin <= cut`` of a number or ``bin == cut`` of a category, so a
missing number goes with the smallest ones, and the features are those of the
one-hot matrix: one per number, one per value of a category.

Training rows travel as blocks of NumPy arrays, one block a partition and fit.
Random draws are hashes of the row's key and what they are for, and histograms
hold whole numbers, so a seed gives the same trees for any dealing of rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from keepwise import constants as K

#: training rows of a block, and of those that a task bins
BLOCK_ROWS = 50_000
#: pairs of row and tree looked at together
PAIRS = 250_000


# --- bins --------------------------------------------------------------------------

@dataclass(frozen=True)
class Binning:
    """Cuts of each numeric feature and values of each category, ascending."""
    num: tuple[str, ...]
    cat: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    values: tuple[tuple[str, ...], ...]

    @property
    def widths(self) -> list[int]:
        return [len(c) + 2 for c in self.cuts] + [len(v) + 1 for v in self.values]

    @property
    def names(self) -> list[str]:
        """The one-hot features, in the order of their slots."""
        return [*self.num, *[f"{c}_{v}" for c, vs in zip(self.cat, self.values) for v in vs]]

    def bins(self, columns: dict[str, pd.Series]) -> np.ndarray:
        """(rows, columns) of bins."""
        out = []
        for c, cuts in zip(self.num, self.cuts):
            x = pd.to_numeric(columns[c]).to_numpy(np.float64, na_value=np.nan)
            out.append(np.where(np.isnan(x), 0, np.searchsorted(np.array(cuts, np.float64), x) + 1))
        for c, values in zip(self.cat, self.values):
            place = {v: i + 1 for i, v in enumerate(values)}
            out.append(columns[c].map(place).to_numpy(np.float64, na_value=0))
        rows = len(out[0]) if out else 0
        return np.stack([np.nan_to_num(x) for x in out], axis=1).astype(np.uint16) if rows else np.zeros((0, len(out)), np.uint16)


def fit_binning(train: DataFrame, num: list[str], cat: list[str], max_bins: int = 256) -> Binning:
    """Bins from all rows of ``train``, in one aggregate.

    A number has at most ``max_bins`` bins, cut at quantiles; a category has
    one for each value (categories are columns of few values).
    """
    shares = [float(i / (max_bins - 1)) for i in range(max_bins - 1)]
    row = train.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), shares, 10_000).alias(c) for c in num],
                    *[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cat]).first()
    cuts = tuple(tuple(sorted(set(row[c] or []))[:max_bins - 2]) for c in num)
    return Binning(tuple(num), tuple(cat), cuts, tuple(tuple(row[c]) for c in cat))


@dataclass(frozen=True)
class Positions:
    """All bins of all columns side by side: what a histogram has a cell for."""
    start: np.ndarray      # first position of each column
    column: np.ndarray     # column of each position
    cut: np.ndarray        # its bin
    equal: np.ndarray      # whether a split there asks for equality
    slot: np.ndarray       # its one-hot feature, -1 where no split is possible
    slots: int

    @cached_property
    def widths(self) -> list[int]:
        """Positions of each column."""
        return np.diff(np.append(self.start, len(self.column))).tolist()

    @property
    def narrow(self) -> type:
        """The narrowest type that holds all bins."""
        return np.uint8 if max(self.widths, default=0) <= 256 else np.uint16

    @cached_property
    def of_slot(self) -> tuple[np.ndarray, np.ndarray]:
        """Column of each slot, and whether it asks for equality."""
        at = np.array([np.flatnonzero(self.slot == s)[0] for s in range(self.slots)], np.int64)
        return self.column[at], self.equal[at]

    @cached_property
    def first(self) -> list[int]:
        """The first slot of each column (of a category without values: where it would be)."""
        return np.searchsorted(self.of_slot[0], np.arange(len(self.start))).tolist()

    @classmethod
    def of(cls, binning: Binning) -> Positions:
        widths = np.array(binning.widths, np.int64)
        start = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int64)
        column = np.repeat(np.arange(len(widths)), widths)
        cut = np.arange(widths.sum()) - start[column]
        equal = column >= len(binning.num)
        first_value = np.cumsum([0] + [len(v) for v in binning.values])[:-1]
        slot = np.where(equal, 0, column)
        for i, at in enumerate(first_value):
            own = column == len(binning.num) + i
            slot[own] = np.where(cut[own] > 0, len(binning.num) + at + cut[own] - 1, -1)
        slot[~equal & (cut == widths[column] - 1)] = -1  # everything would go left
        return cls(start, column, cut, equal, slot, len(binning.names))

    def left(self, cells: np.ndarray) -> np.ndarray:
        """What goes left at each position, from cells of the last axis."""
        upto = np.cumsum(cells, axis=-1)
        before = np.concatenate([np.zeros((*cells.shape[:-1], 1)), upto], axis=-1)[..., self.start]
        return np.where(self.equal, cells, upto - before[..., self.column])

    def histogram(self, bins: np.ndarray, node: np.ndarray, nodes: int, weights: list[np.ndarray]) -> np.ndarray:
        """(weights, nodes, positions): sums of each weight, whole numbers below 2**53."""
        size = len(self.column)
        at = (node[:, None] * size + self.start + bins).ravel()
        cells = [np.bincount(at, np.repeat(w, bins.shape[1]), nodes * size) for w in weights]
        return np.stack(cells).reshape(len(weights), nodes, size)


def columns_together(columns: list[int], widths: list[int], most: int) -> list[list[int]]:
    """Groups of columns whose bins together have at most ``most`` codes; a wider column is a group."""
    out: list[list[int]] = []
    size = lambda group: int(np.prod([widths[c] for c in group]))
    for c in sorted(columns, key=lambda c: -widths[c]):
        found = next((g for g in out if size([*g, c]) <= most), None)
        if found is None:
            out.append([c])
        else:
            found.append(c)
    return out


# --- rows --------------------------------------------------------------------------------

def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each number and a salt."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def share_of(x: np.ndarray) -> np.ndarray:
    """Mixed bits as numbers in [0, 1)."""
    return (x >> np.uint64(11)) * (1.0 / (1 << 53))


@dataclass
class Block:
    """Some of the training rows of one fit."""
    fit: int
    key: np.ndarray
    y: np.ndarray
    bins: np.ndarray
    margin: np.ndarray | None = None

    def where(self, rows: np.ndarray) -> Block:
        return Block(self.fit, self.key[rows], self.y[rows], self.bins[rows], None if self.margin is None else self.margin[rows])


def joined(blocks: list[Block]) -> Block:
    return blocks[0] if len(blocks) == 1 else Block(blocks[0].fit, *[np.concatenate([getattr(b, f) for b in blocks]) for f in ("key", "y", "bins")])


def parts_of(n: int, block_rows: int | None = None) -> int:
    return max(1, -(-n // (block_rows or BLOCK_ROWS)))


def blocks_of(train: DataFrame, binning: Binning, n: int, fits: int, fold: str | None = "fold", label: str = "label",
              block_rows: int | None = None) -> RDD:
    """The blocks of each fit: fit i leaves out fold i, the last fit has all rows.

    ``n`` rows are dealt by id to ``parts_of(n, block_rows)`` blocks; a task bins
    ``BLOCK_ROWS`` of them.
    """
    parts = parts_of(n, block_rows)
    packs = parts * parts_of(-(-n // parts))
    columns = [*binning.num, *binning.cat]
    rows = train.select(F.xxhash64(F.col(K.ID_COL).cast("string")).alias("__key"), F.col(label).cast("int").alias("__y"),
                        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("__fold"), *columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            pdf = pa.Table.from_batches(held).to_pandas()
            arrays = [pdf["__key"].to_numpy(np.int64), pdf["__y"].to_numpy(np.int8), pdf["__fold"].to_numpy(np.int32), binning.bins(pdf)]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays], names=names)

    names = ["key", "y", "fold", "bins"]
    packed = rows.repartition(packs, "__key").mapInArrow(pack, ", ".join(f"{c} binary" for c in names))

    def unpack(part: int, stored: Iterator) -> Iterator[tuple[tuple[int, int], Block]]:
        for row in stored:
            key, y, fold = (np.frombuffer(row[c], t) for c, t in (("key", np.uint64), ("y", np.int8), ("fold", np.int32)))
            bins = np.frombuffer(row["bins"], np.uint16).reshape(len(y), -1)
            for i in range(fits):
                own = np.flatnonzero(fold != i)
                yield (i, part % parts), Block(i, key[own], y[own], bins[own])

    def gathered(blocks: Iterator[Block]) -> list[Block]:
        have = list(blocks)
        return [joined(have)] if have else []

    return packed.rdd.mapPartitionsWithIndex(unpack).partitionBy(fits * parts, lambda k: k[0] * parts + k[1]).values().mapPartitions(gathered)


# --- fitted trees ----------------------------------------------------------------------------

@dataclass
class Nodes:
    """A tree as arrays: children of node i are left[i] and left[i] + 1; leaves have column -1."""
    column: np.ndarray
    cut: np.ndarray
    equal: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.column)


class NodeList:
    """A tree while it grows."""

    def __init__(self):
        self.column, self.cut, self.equal, self.left, self.value = [], [], [], [], []

    def add(self, value: float = 0.0) -> int:
        for have, x in zip((self.column, self.cut, self.equal, self.left, self.value), (-1, 0, False, 0, value)):
            have.append(x)
        return len(self.column) - 1

    def split(self, node: int, column: int, cut: int, equal: bool) -> int:
        left = self.add()
        self.add()
        self.column[node], self.cut[node], self.equal[node], self.left[node] = column, cut, equal, left
        return left

    def nodes(self) -> Nodes:
        return Nodes(np.array(self.column, np.int16), np.array(self.cut, np.uint16), np.array(self.equal, bool),
                     np.array(self.left, np.int32), np.array(self.value, np.float64))


def places(tree: Nodes | NodeList, bins: np.ndarray) -> np.ndarray:
    """The leaf of one tree that each row of bins comes to."""
    tree = tree.nodes() if isinstance(tree, NodeList) else tree
    return leaves(tree, np.zeros(1, np.int64), bins)[:, 0]


def leaves(t: Nodes, roots: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """(rows, trees): the leaf of each tree, whose nodes lie in one set of arrays."""
    # a node in one number: leaf or not, column, cut, whether it asks for equality, left child (a leaf: itself)
    split, here = t.column >= 0, np.arange(len(t))
    code = np.where(split, t.column.astype(np.int64) << 48 | t.cut.astype(np.int64) << 32 | t.equal.astype(np.int64) << 31 | t.left,
                    np.int64(-1 << 63) | np.int64(0xFFFF << 32) | here)
    flat, width = bins.ravel(), bins.shape[1]
    out = np.tile(roots, len(bins))
    node, row, going = out, np.repeat(np.arange(len(bins)) * width, len(roots)), None
    while True:
        x = code.take(node)
        live = x >= 0
        n = np.count_nonzero(live)
        if n == 0 or n < 0.75 * len(x):  # those that have come to a leaf are put away
            out[slice(None) if going is None else going] = node
            if n == 0:
                return out.reshape(len(bins), len(roots))
            own = np.flatnonzero(live)
            going = own if going is None else going[own]
            x, row = x[own], row[own]
        b, cut = flat.take(row + (x >> 48 & 0x7FFF)), x >> 32 & 0xFFFF
        node = (x & 0x7FFFFFFF) + ((b > cut) | (b < cut) & (x >> 31 & 1).astype(bool))


@dataclass
class TreeEnsemble:
    """Fitted trees, scored on executors from the feature columns themselves.

    ``kind`` is ``boosting`` (values add up to a log odds) or ``forest``
    (values are probabilities, averaged).
    """
    kind: str
    binning: Binning
    trees: Nodes
    roots: np.ndarray
    base: float
    importances: np.ndarray
    _sent: object = field(default=None, repr=False, compare=False)

    @classmethod
    def of(cls, kind: str, binning: Binning, trees: list[Nodes], base: float, importances: np.ndarray) -> TreeEnsemble:
        roots = np.cumsum([0] + [len(t) for t in trees])[:-1].astype(np.int64)
        parts = {f: np.concatenate([getattr(t, f) for t in trees]) for f in ("column", "cut", "equal", "value")}
        left = np.concatenate([t.left + r for t, r in zip(trees, roots)]).astype(np.int32)
        total = importances.sum()
        return cls(kind, binning, Nodes(left=left, **parts), roots, base, importances / total if total > 0 else importances)

    def margins(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        roots = self.roots[:trees]
        step, out = max(1, PAIRS // max(1, len(roots))), []
        for i in range(0, len(bins), step):
            values = self.trees.value[leaves(self.trees, roots, bins[i:i + step])]
            out.append(values.sum(axis=1) if self.kind == "boosting" else values.mean(axis=1))
        return self.base + (np.concatenate(out) if out else np.zeros(0))

    def probabilities(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        """Of class 1, from the first ``trees`` trees (default: all)."""
        x = self.margins(bins, trees)
        return 1 / (1 + np.exp(-x)) if self.kind == "boosting" else x

    def probability(self, spark: SparkSession) -> Column:
        """The probability of class 1 as a column over the feature columns."""
        if self._sent is None:  # bounded: boosted trees of a fixed depth; a forest where a stream asks for it
            self._sent = spark.sparkContext.broadcast((self.kind, self.binning, self.trees, self.roots, self.base, self.importances))
        sent, columns = self._sent, [*self.binning.num, *self.binning.cat]

        @pandas_udf("double")
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = TreeEnsemble(*sent.value)
            for pdf in batches:
                yield pd.Series(model.probabilities(model.binning.bins(pdf)))

        return score(F.struct(*[F.col(c).cast("double").alias(c) for c in self.binning.num],
                              *[F.col(c).cast("string").alias(c) for c in self.binning.cat])) if columns else F.lit(0.5)

    # --- stored form: a row per tree, and a row that says the rest ---

    def save(self, spark: SparkSession, path: str) -> None:
        ends = np.append(self.roots[1:], len(self.trees))
        rows = [(i, *[np.ascontiguousarray(getattr(self.trees, f)[a:b]).tobytes() for f in FIELDS]) for i, (a, b) in enumerate(zip(self.roots, ends))]
        schema = "tree int, " + ", ".join(f"{f} binary" for f in FIELDS)
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/trees")
        save_head(spark, path, self.kind, self.base, self.binning, self.importances)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeEnsemble:
        kind, base, binning, importances = load_head(spark, path)
        stored = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()  # as large as the model itself
        return cls.of_stored(kind, binning, stored, base, importances)

    @classmethod
    def of_stored(cls, kind: str, binning: Binning, stored: list, base: float, importances: np.ndarray) -> TreeEnsemble:
        """From rows of the stored form."""
        trees = [stored_nodes(r) for r in stored]
        roots = np.cumsum([0] + [len(t) for t in trees])[:-1].astype(np.int64)
        parts = {f: np.concatenate([getattr(t, f) for t in trees]) for f in ("column", "cut", "equal", "value")}
        left = np.concatenate([t.left + r for t, r in zip(trees, roots)]).astype(np.int32)
        return cls(kind, binning, Nodes(left=left, **parts), roots, base, importances)


def stored_nodes(row) -> Nodes:
    """A tree of the stored form, whose nodes may be numbered over all trees: a root's first child is 1 here."""
    t = Nodes(**{f: np.frombuffer(row[f], kind) for f, kind in FIELDS.items()})
    t.left = t.left - (t.left[0] - (t.column[0] >= 0))
    return t


def save_head(spark: SparkSession, path: str, kind: str, base: float, b: Binning, importances: np.ndarray) -> None:
    head = [(kind, float(base), list(b.num), list(b.cat), [list(c) for c in b.cuts], [list(v) for v in b.values], [float(x) for x in importances])]
    spark.createDataFrame(head, HEAD).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


def load_head(spark: SparkSession, path: str) -> tuple[str, float, Binning, np.ndarray]:
    head = spark.read.parquet(f"{path}/head").first()
    binning = Binning(tuple(head["num"]), tuple(head["cat"]), tuple(map(tuple, head["cuts"])), tuple(map(tuple, head["values"])))
    return head["kind"], head["base"], binning, np.array(head["importances"])


#: arrays of a stored tree
FIELDS = {"column": np.int16, "cut": np.uint16, "equal": bool, "left": np.int32, "value": np.float64}
HEAD = ("kind string, base double, num array<string>, cat array<string>, cuts array<array<double>>, values array<array<string>>, "
        "importances array<double>")
