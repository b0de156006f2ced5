"""A random forest of unlimited depth, of several fits at once.

While a node holds more rows than one task takes, all trees grow it together: one
aggregate per level counts classes per (fit, tree, node, bin), and the splits
are chosen where the counts meet. A smaller node's rows go to one task, which
grows the whole sub-tree. Both choose splits by the same rule from the same
whole-number counts and draws, so where a node is grown changes nothing.

The trees stay on executors: a forest is a table of the shared folder, a row per
tree, and is scored by a join of few trees with a slice of the rows. The driver
holds bins, importances and, while nodes are large, the tops of the trees.

As in the reference a node is split until it is pure or no feature parts it;
each split takes the best of about the square root of the features, more only
while none of those parts the rows; rows are drawn with repetition per tree.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, TaskContext
from pyspark.core.rdd import portable_hash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keepwise.functions.staging import staged
from keepwise.operators import trees as T
from keepwise.operators.trees import Binning, Block, NodeList, Nodes, Positions, TreeEnsemble, mixed, places, share_of

#: drawn rows up to which one task grows a node
GROWN_ROWS = 1_000_000
#: trees that one task grows from one copy of the rows
TREES_A_TASK = 10
#: trees and rows that one task scores: a tree has a node per few training rows
SCORED_TREES, SCORED_ROWS = 20, 250_000
#: pairs of node and feature that one task looks at together
CELLS = 1_000_000
#: distribution of the times a row is drawn, as the number of rows grows
_TIMES = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 300
    seed: int = 42


def times_drawn(key: np.ndarray, tree: int, settings: ForestSettings) -> np.ndarray:
    return np.searchsorted(_TIMES, share_of(mixed(mixed(key, settings.seed), tree)), side="right")


def draw_order(uid: np.ndarray, slots: int) -> np.ndarray:
    """(nodes, slots): the features in the order in which each node tries them."""
    return np.argsort(mixed(uid[:, None] ^ mixed(np.arange(slots), 1), 2), axis=1)


def children(uid: np.ndarray) -> np.ndarray:
    """(nodes, 2): the identities of the children, from which their draws come."""
    return np.stack([mixed(uid, 1_000_003), mixed(uid, 1_000_033)], axis=1)


def purity(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted rows less the weighted Gini impurity, from class counts in the first axis."""
    a, b = counts[0] * weight[0], counts[1] * weight[1]
    total = a + b
    return np.divide(a * a + b * b, total, out=np.zeros(np.shape(total)), where=total > 0)


def _share(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted share of class 1 (no rows: one half)."""
    a, b = counts[0] * weight[0], counts[1] * weight[1]
    return np.divide(b, a + b, out=np.full(np.shape(a), 0.5), where=a + b > 0)


class Tree(NodeList):
    """A tree while it grows: its open nodes, and what its splits gained by feature."""

    def __init__(self, uid: int, slots: int):
        super().__init__()
        self.add()
        self.uid = {0: uid}  # of open nodes
        self.gain = np.zeros(slots)

    def part(self, node: int, split: tuple) -> None:
        gain, slot, column, cut, equal = split
        left = self.split(node, column, cut, equal)
        self.uid[left], self.uid[left + 1] = (int(x) for x in children(np.array([self.uid.pop(node)], np.uint64))[0])
        self.gain[slot] += gain

    def graft(self, node: int, sub: Nodes, gain: np.ndarray) -> None:
        """Puts a sub-tree where ``node`` is."""
        left = np.where(sub.column >= 0, sub.left + len(self.column) - 1, 0)  # its root takes the node's place
        for have, new in zip((self.column, self.cut, self.equal, self.left, self.value), (sub.column, sub.cut, sub.equal, left, sub.value)):
            have[node], *rest = new.tolist()
            have.extend(rest)
        self.gain += gain
        self.uid.pop(node, None)


def tries(slots: int) -> int:
    return max(1, int(np.sqrt(slots)))


# --- a sub-tree in one task ----------------------------------------------------------------

def grow_here(block: Block, times: np.ndarray, uid: int, positions: Positions, weight: np.ndarray) -> Tree:
    """The tree of a node's rows, level by level, all nodes of a level together.

    The rows of a level lie in the order of its open nodes, each with its bins, class and times drawn side by side.
    """
    own = np.flatnonzero(times)
    rows = np.concatenate([block.bins[own], block.y[own, None], times[own, None]], axis=1, dtype=positions.narrow, casting="unsafe")
    total = np.bincount(block.y[own], times[own], 2)[:, None]
    ids, uids, sizes = np.zeros(1, np.int64), np.array([uid], np.uint64), np.array([len(own)])  # of the open nodes
    made, values = 1, [_share(total, weight)]
    gains, parents = np.zeros(positions.slots), []
    if not (total > 0).all():
        ids = ids[:0]
    while len(ids):
        some = max(1, CELLS // max(1, positions.slots))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        found = []
        for i in range(0, len(ids), some):
            at = slice(i, i + some)
            found.append(_splits_here(rows[ends[i]:ends[min(i + some, len(ids))]], sizes[at], uids[at], total[:, at], positions, weight))
        gain, slot, cut = (np.concatenate(x) for x in list(zip(*found))[:3])
        left = np.concatenate([x[3] for x in found], axis=1)
        parted = np.flatnonzero(slot >= 0)
        if not len(parted):
            break
        np.add.at(gains, slot[parted], gain[parted])
        column, equal = positions.of_slot[0][slot], positions.of_slot[1][slot]
        new = made + 2 * np.arange(len(parted))
        parents.append((ids[parted], column[parted], cut[parted], equal[parted], new))
        made += 2 * len(parted)
        total = np.stack([left, total - left], axis=2).reshape(2, -1)
        values.append(_share(total.reshape(2, -1, 2)[:, parted].reshape(2, -1), weight))
        # the rows of children that hold both classes, in the order of these
        open_ = (total > 0).all(axis=0) & np.repeat(slot >= 0, 2)
        number = np.where(open_, np.cumsum(open_) - 1, open_.sum()).astype(np.uint16 if open_.sum() < 65536 else np.int64)
        b = rows.ravel()[np.arange(0, rows.size, rows.shape[1]) + np.repeat(column, sizes)]
        c, e = np.repeat(cut.astype(rows.dtype), sizes), np.repeat(equal, sizes)
        child = np.repeat(2 * np.arange(len(ids)), sizes) + ((b > c) ^ (e & (b < c)))
        order = np.argsort(number[child], kind="stable")
        sizes = np.bincount(child, minlength=len(open_))[open_]
        rows, total = rows.take(order[:sizes.sum()], axis=0), total[:, open_]
        children_ids = np.zeros((len(slot), 2), np.int64)
        children_ids[parted] = np.stack([new, new + 1], axis=1)
        ids, uids = children_ids.ravel()[open_], children(uids).ravel()[open_]
    tree = Tree(uid, positions.slots)
    tree.uid, tree.gain, tree.value = {}, gains, np.concatenate(values, axis=None).tolist()
    for i, (f, none) in enumerate((("column", -1), ("cut", 0), ("equal", False), ("left", 0))):
        have = np.full(made, none)
        for nodes, *split in parents:
            have[nodes] = split[i]
        setattr(tree, f, have.tolist())
    return tree


def _splits_here(rows: np.ndarray, sizes: np.ndarray, uids: np.ndarray, total: np.ndarray, positions: Positions,
                 weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of some nodes, whose rows follow each other: gain, slot (-1: nothing parts the node), cut, class counts to the left."""
    k, slots, most = len(sizes), positions.slots, tries(positions.slots)
    rank = np.empty((k, slots), np.int32)
    np.put_along_axis(rank, draw_order(uids, slots), np.arange(slots, dtype=np.int32)[None, :], axis=1)
    base = purity(total, weight)
    gain, cut = np.full((k, slots), -np.inf), np.zeros((k, slots), np.int64)  # where a slot parts a node
    left = np.zeros((2, k, slots))
    y, drawn = rows[:, -2], rows[:, -1].astype(np.float64)
    node, ends = np.repeat(np.arange(k), sizes), np.cumsum(sizes)
    classed, key = node + y * np.int64(k), np.empty(len(rows), np.int64)
    numbers = np.flatnonzero(~positions.of_slot[1])
    for c in range(len(numbers), len(positions.widths)):  # categories: all their values at once
        w = positions.widths[c]
        np.multiply(classed, w, out=key)
        np.add(key, rows[:, c], out=key)
        own = slice(positions.first[c], positions.first[c] + w - 1)
        left[:, :, own] = np.bincount(key, drawn, 2 * k * w).reshape(2, k, w)[:, :, 1:]
        cut[:, own] = np.arange(1, w)
    if len(numbers) < slots:
        at = slice(len(numbers), None)
        right = total[:, :, None] - left[:, :, at]
        here = (left[:, :, at].sum(axis=0) > 0) & (right.sum(axis=0) > 0)
        gain[:, at] = np.where(here, purity(left[:, :, at], weight) + purity(right, weight) - base[:, None], -np.inf)

    def look(c: int, asked: np.ndarray) -> None:
        """The best cut of a number in the nodes ``asked``."""
        own = np.flatnonzero(asked)
        if not len(own):
            return
        at = np.repeat(ends[own] - np.cumsum(sizes[own]), sizes[own]) + np.arange(sizes[own].sum())
        w = positions.widths[c]
        place, counts = _cells(np.repeat(np.arange(len(own)) * w, sizes[own]) + rows[at, c], y[at], drawn[at], len(own) * w)
        which, value = place // w, place % w
        start = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        cells = np.diff(np.append(start, len(which)))
        upto = np.cumsum(counts, axis=1)
        upto -= np.repeat(np.concatenate([np.zeros((2, 1)), upto[:, start[1:] - 1]], axis=1), cells, axis=1)
        right = total[:, own[which]] - upto
        made = np.where(right.sum(axis=0) > 0, purity(upto, weight) + purity(right, weight) - base[own[which]], -1.0)
        hit = np.flatnonzero(made == np.repeat(np.maximum.reduceat(made, start), cells))
        hit = hit[np.append(True, which[hit][1:] != which[hit][:-1])]  # the smallest cut of equals
        hit = hit[made[hit] >= 0]  # a split that gains nothing still parts the rows
        n = own[which[hit]]
        gain[n, c], cut[n, c], left[:, n, c] = made[hit], value[hit], upto[:, hit]

    for c in numbers.tolist():
        look(c, rank[:, c] < most)
    among = np.where(rank < most, gain, -np.inf)
    best = among.max(axis=1, initial=-1.0)
    # the first tried of those that gain most; where none of them parts the node the first that does
    slot = np.where(among == best[:, None], rank, slots).argmin(axis=1) if slots else np.zeros(k, np.int64)
    lost = best == -1.0
    if lost.any() and slots:
        for c in numbers.tolist():
            look(c, lost)
        later = np.where(gain[lost] > -1.0, rank[lost], slots)
        slot[lost] = np.where(later.min(axis=1) < slots, later.argmin(axis=1), -1)
    elif not slots:
        slot[:] = -1
    each = np.arange(k)
    return (gain[each, slot], slot, cut[each, slot], left[:, each, slot]) if slots else (base, slot, slot, total)


def _cells(key: np.ndarray, y: np.ndarray, drawn: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that rows have, ascending, and their class counts."""
    if places <= 2 * len(key):
        n = np.bincount(key + y * np.int64(places), drawn, 2 * places).reshape(2, places)
        at = np.flatnonzero(n[0] + n[1])
        return at, n[:, at]
    x = ((key * 2 + y) * 16 + drawn.astype(np.int64)).astype(np.int32 if places < 1 << 26 else np.int64)
    x.sort()
    at, y, drawn = x >> 5, (x >> 4) & 1, x & 15
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    one, both = (np.add.reduceat(d, start, dtype=np.float64) for d in (drawn * y, drawn))
    return at[start].astype(np.int64), np.stack([both - one, one])


# --- large nodes, all trees together --------------------------------------------------------

def _level_counts(block: Block, trees: dict[int, Tree], large: dict[int, list[int]], positions: Positions, settings: ForestSettings) -> Iterator:
    """((fit, tree), class counts of its large nodes by position) of a block."""
    for t, nodes in large.items():
        number = np.full(len(trees[t].column), -1)
        number[nodes] = np.arange(len(nodes))
        times = times_drawn(block.key, t, settings)
        at = number[places(trees[t], block.bins)]
        rows = np.flatnonzero((at >= 0) & (times > 0))
        w = times[rows].astype(np.float64)
        y = block.y[rows]
        yield (block.fit, t), positions.histogram(block.bins[rows], at[rows], len(nodes), [w * (y == 0), w * (y == 1)])


def _level_splits(counts: np.ndarray, uids: list[int], positions: Positions, weight: np.ndarray) -> list[tuple]:
    """Of each node its class counts and its split, or None, by the rule of ``grow_here``."""
    first = slice(positions.start[0], positions.start[1] if len(positions.start) > 1 else None)
    total = counts[:, :, first].sum(axis=2)
    left = positions.left(counts)
    right = total[:, :, None] - left
    made = purity(left, weight) + purity(right, weight) - purity(total, weight)[:, None]
    parts = (left.sum(axis=0) > 0) & (right.sum(axis=0) > 0) & (positions.slot >= 0)
    order = draw_order(np.array(uids, np.uint64), positions.slots)
    out = []
    for i in range(len(uids)):
        best, split = -1.0, None
        for j, s in enumerate(order[i].tolist()):
            if split is not None and j >= tries(positions.slots) or (total[:, i] == 0).any():
                break
            own = np.flatnonzero((positions.slot == s) & parts[i])
            if len(own):
                at = own[made[i, own].argmax()]
                if made[i, at] > best and made[i, at] >= 0:
                    best = float(made[i, at])
                    split = (best, s, int(positions.column[at]), int(positions.cut[at]), bool(positions.equal[at]))
        out.append((total[:, i], split))
    return out


def grow_forests(blocks: RDD, fits: int, binning: Binning, settings: ForestSettings = ForestSettings(),
                 block_rows: int | None = None) -> list[Forest]:
    """The forest of each of ``fits`` fits (``blocks_of``).

    ``block_rows`` (default: ``GROWN_ROWS``) are the drawn rows up to which one
    task grows a node. ``blocks`` are read once a level and should be persisted.
    Trees are written by the tasks that finish them; of each the driver gets its
    gains by feature only.
    """
    block_rows = GROWN_ROWS if block_rows is None else block_rows
    positions = Positions.of(binning)
    classes = blocks.map(lambda b: (b.fit, np.bincount(b.y, minlength=2))).reduceByKey(np.add).collectAsMap()
    weight = {f: n.sum() / (2.0 * np.maximum(n, 1)) for f, n in classes.items()}  # balanced
    roots = dict(enumerate(mixed(np.arange(settings.trees), 7_000_003 + settings.seed).tolist()))
    forests = {f: {t: Tree(roots[t], positions.slots) for t in range(settings.trees)} for f in range(fits)}

    # shared levels; a node's size is known from its parent's counts, the root's from the fit
    large = {f: {t: [0] for t in forests[f]} if classes[f].sum() > block_rows else {} for f in range(fits)}
    while any(large.values()):
        sent = {f: ({t: forests[f][t] for t in large[f]}, large[f]) for f in range(fits) if large[f]}
        uids = {(f, t): [forests[f][t].uid[n] for n in nodes] for f in sent for t, nodes in large[f].items()}
        counted = blocks.filter(lambda b: b.fit in sent).flatMap(lambda b: _level_counts(b, *sent[b.fit], positions, settings))
        splits = counted.reduceByKey(np.add).map(lambda kv: (kv[0], _level_splits(kv[1], uids[kv[0]], positions, weight[kv[0][0]]))).collectAsMap()
        following = {f: {} for f in range(fits)}
        for (f, t), found in splits.items():
            tree, again = forests[f][t], []
            for node, (total, split) in zip(large[f][t], found):
                tree.value[node] = float(_share(total, weight[f]))
                if split is None:
                    tree.uid.pop(node)
                else:
                    tree.part(node, split)
                    again += [tree.left[node], tree.left[node] + 1]
            if again:
                following[f][t] = again
        large = _still_large(blocks, forests, following, settings, block_rows)

    def emit(block: Block) -> Iterator[tuple[tuple, tuple[Block, list]]]:
        """A copy of the rows per few trees that are still a root, and the rows of each open node of the others."""
        own = forest_keys[block.fit]
        block = Block(block.fit, block.key, block.y, block.bins.astype(narrow))
        fresh = [t for t, (tree, _) in own.items() if tree is None]
        for i in range(turns):
            some = fresh[i::turns]
            if some:
                yield (block.fit, i, -1), (block, [(t, 0, roots[t]) for t in some])
        for t, (tree, open_nodes) in own.items():
            if tree is not None and open_nodes:
                at = places(tree, block.bins)
                drawn = times_drawn(block.key, t, settings) > 0
                for node, uid in open_nodes.items():
                    yield (block.fit, t, node), (block.where(np.flatnonzero(drawn & (at == node))), [(t, node, uid)])

    forest_keys = {f: {t: (None if len(tree.column) == 1 else tree.nodes(), dict(tree.uid)) for t, tree in own.items()} for f, own in forests.items()}

    def grow(group: tuple) -> Iterator[tuple[tuple[int, int], tuple[int, Nodes, np.ndarray]]]:
        (fit, _, _), given = group
        given = list(given)
        block = T.joined([b for b, _ in given])
        for t, node, uid in given[0][1]:
            sub = grow_here(block, times_drawn(block.key, t, settings), uid, positions, weight[fit])
            yield (fit, t), (node, sub.nodes(), sub.gain)

    def whole(group: tuple) -> tuple[tuple[int, int], tuple[int, Nodes, np.ndarray]]:
        """The top of a tree (node -1) with the sub-trees of its open nodes."""
        at, given = group
        given = sorted(given, key=lambda x: x[0])
        if given[0][0] >= 0:
            return at, given[0]
        tree = given[0][1]
        for node, sub, gain in given[1:]:
            tree.graft(node, sub, gain)
        return at, (0, tree.nodes(), tree.gain)

    turns = max(1, -(-settings.trees // TREES_A_TASK))
    groups = fits * turns
    narrow = positions.narrow

    def task(key: tuple) -> int:
        """Whole trees of a fit are dealt evenly."""
        fit, tree, node = key
        return fit * turns + tree % turns if node < 0 else portable_hash(key)

    grown = blocks.flatMap(emit).groupByKey(groups, task).flatMap(grow)
    tops = [((f, t), (-1, tree, tree.gain)) for f, own in forests.items() for t, tree in own.items() if len(tree.column) > 1]
    if tops:
        grown = grown.union(blocks.context.parallelize(tops, 1)).groupByKey(groups).map(whole)
    spark = SparkSession.builder.getOrCreate()
    packed = grown.map(lambda x: (*x[0], *[_bytes(getattr(x[1][1], f)) for f in T.FIELDS], x[1][2].tolist()))
    table = staged(spark.createDataFrame(packed, STORED, verifySchema=False), "forests", by="fit")
    out = []
    per_tree = table.select("fit", "tree", "gain").orderBy("fit", "tree").collect()  # a number per tree and feature
    for f in range(fits):
        gains = [g / g.sum() for g in (np.array(r["gain"]) for r in per_tree if r["fit"] == f) if g.sum() > 0]
        total = np.sum(gains, axis=0) if gains else np.zeros(positions.slots)
        own = table.where(F.col("fit") == f).select("tree", *T.FIELDS)
        out.append(Forest(binning, own, settings.trees, total / total.sum() if total.sum() > 0 else total))
    return out


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _still_large(blocks: RDD, forests: dict, following: dict, settings: ForestSettings, block_rows: int) -> dict:
    """Of the new open nodes those that draw more rows than a block."""
    sent = {f: {t: (forests[f][t].nodes(), nodes) for t, nodes in own.items()} for f, own in following.items() if own}

    def sizes(block: Block) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        for t, (tree, nodes) in sent[block.fit].items():
            drawn = times_drawn(block.key, t, settings) > 0
            yield (block.fit, t), np.bincount(places(tree, block.bins)[drawn], minlength=len(tree))[nodes]

    found = blocks.filter(lambda b: b.fit in sent).flatMap(sizes).reduceByKey(np.add).collectAsMap()
    large: dict = {f: {} for f in following}
    for (f, t), rows in found.items():
        nodes = [n for n, size in zip(following[f][t], rows) if size > block_rows]
        if nodes:
            large[f][t] = nodes
    return large


# --- fitted forests --------------------------------------------------------------------------

STORED = "fit int, tree int, " + ", ".join(f"{f} binary" for f in T.FIELDS) + ", gain array<double>"


@dataclass
class Forest:
    """A fitted forest: its trees are ``table`` (``TreeEnsemble``'s stored form), the driver holds the rest."""
    binning: Binning
    table: DataFrame
    count: int
    importances: np.ndarray
    kind = "forest"

    @cached_property
    def held(self) -> TreeEnsemble:
        """The forest with its trees in memory, as a stream's scoring expression needs it."""
        stored = self.table.orderBy("tree").collect()  # as large as the forest
        return TreeEnsemble.of_stored("forest", self.binning, stored, 0.0, self.importances)

    @property
    def trees(self) -> Nodes:
        return self.held.trees

    def probabilities(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        return self.held.probabilities(bins, trees)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/trees")
        T.save_head(spark, path, self.kind, 0.0, self.binning, self.importances)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        _, _, binning, importances = T.load_head(spark, path)
        table = spark.read.parquet(f"{path}/trees").select("tree", *T.FIELDS)
        return cls(binning, table, table.count(), importances)


def load_trees(spark: SparkSession, path: str) -> Forest | TreeEnsemble:
    return (Forest if T.load_head(spark, path)[0] == "forest" else TreeEnsemble).load(spark, path)


def score_forests(df: DataFrame, forests: dict[str, Forest], keep: list[str]) -> DataFrame:
    """``keep`` of ``df`` and the probability of class 1 by each of ``forests`` (out column -> forest)."""
    return _scored(df, list(forests.values()), keep, list(forests))


def score_by_own(df: DataFrame, forests: list[Forest], own: str, keep: list[str], out: str) -> DataFrame:
    """``keep`` of the rows whose column ``own`` is the place of one of ``forests``, and the probability of class 1 by that one."""
    return _scored(df.where(F.col(own).isin(list(range(len(forests))))), forests, keep, [out], own)


def _scored(df: DataFrame, forests: list[Forest], keep: list[str], outs: list[str], own: str | None = None) -> DataFrame:
    """``keep`` and ``outs``: a column for each forest, or one by the forest that column ``own`` tells.

    Rows are packed into blocks, written once, those of one ``own`` together.
    ``SCORED_TREES`` trees and the blocks of a slice of about ``SCORED_ROWS``
    rows meet in a task, whose sums return to the block's rows.
    """
    if not all(f.binning.names for f in forests):
        return df.select(*keep, *[F.lit(0.5).alias(c) for c in outs])
    binnings: list[Binning] = []
    for f in forests:
        if f.binning not in binnings:
            binnings.append(f.binning)
    features = {(c, t) for b in binnings for cs, t in ((b.num, "double"), (b.cat, "string")) for c in cs}
    rows = df.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), (F.col(own) if own else F.lit(-1)).cast("int").alias("own"),
                     *[F.col(c).cast(t).alias(f"{t}_{c}") for c, t in sorted(features)])
    schema = StructType([*rows.schema["kept"].dataType.fields, *[StructField(c, DoubleType()) for c in outs]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch, i in ((b.filter(pc.equal(b["own"], i)), i) for b in batches for i in pc.unique(b["own"]).to_pylist()):
            kept = pa.RecordBatch.from_struct_array(batch["kept"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as out:
                out.write_batch(kept)
            at = lambda c, t: batch[f"{t}_{c}"].to_pandas()
            bins = [_bytes(b.bins({**{c: at(c, "double") for c in b.num}, **{c: at(c, "string") for c in b.cat}})) for b in binnings]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([i], pa.int32()), pa.array([batch.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                                              pa.array([bins], pa.list_(pa.binary()))], names=["block", "own", "n", "kept", "bins"])
            block += 1

    packed = staged(rows.mapInArrow(pack, "block long, own int, n long, kept binary, bins array<binary>"), "blocks")
    n = packed.groupBy("own").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0  # that a forest scores
    slices = max(1, -(-n // SCORED_ROWS))
    tasks = [(i, g, binnings.index(f.binning)) for i, f in enumerate(forests) for g in range(-(-f.count // SCORED_TREES))]
    task = F.explode(F.array(*[F.struct(F.lit(i).alias("model"), F.lit(g).alias("part"), F.lit(b).alias("binning")) for i, g, b in tasks]))
    asked = packed.withColumn("task", task).where("own IN (-1, task.model)").select(
        "task.model", "task.part", F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice"), "block", F.col("bins")[F.col("task.binning")].alias("bins"))
    trees = reduce(DataFrame.unionByName, [f.table.select(
        F.lit(i).alias("model"), F.floor(F.col("tree") / SCORED_TREES).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), "tree", *T.FIELDS) for i, f in enumerate(forests)])
    widths = [len(f.binning.widths) for f in forests]

    def add(key: tuple, own: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        model, part, _ = (int(x) for x in key)
        bins = [np.frombuffer(b, np.uint16).reshape(-1, widths[model]) for b in blocks["bins"]]
        ends = np.cumsum([len(b) for b in bins])[:-1]
        bins = np.concatenate(bins) if bins else np.zeros((0, widths[model]), np.uint16)
        total = np.zeros(len(bins))
        for tree in own.sort_values("tree").to_dict("records"):
            nodes = T.stored_nodes(tree)
            total += nodes.value[places(nodes, bins)]
        sums = [_bytes(x) for x in np.split(total, ends)][:len(blocks)]
        return pd.DataFrame({"block": blocks["block"], "model": model, "part": part, "sums": sums})

    by = ["model", "part", "slice"]
    sums = trees.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(add, "block long, model int, part int, sums binary")
    sums = sums.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("model", "part", "sums"))).alias("parts"))
    counts = [f.count for f in forests]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept, at, parts in zip(batch["kept"], batch["own"].to_pylist(), batch["parts"]):
                table = pa.ipc.open_stream(kept.as_py()).read_all()
                totals = np.zeros((len(counts), table.num_rows))
                for p in parts.as_py():
                    totals[p["model"]] += np.frombuffer(p["sums"])
                for out, i in zip(outs, [at] if own else range(len(counts))):
                    table = table.append_column(out, pa.array(totals[i] / counts[i]))
                yield from table.to_batches()

    return staged(packed.select("block", "own", "kept").join(sums, "block").select("kept", "own", "parts").mapInArrow(unpack, schema), "scored")
