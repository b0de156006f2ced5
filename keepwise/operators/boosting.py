"""Gradient boosting of several fits at once, with second-order leaves.

For each level of the trees of a round, one aggregate over all fits sums
gradient and curvature per (fit, node, bin); the best split of each node is
chosen where its sums meet, and only splits reach the driver. A fit whose rows
are one block (``BLOCK_ROWS``) needs no exchange: its rounds run where the block
is, by the same rules and with the same result. Sums are of whole numbers (gradients
in units of 2**-20), so they don't depend on how rows are dealt.

Settings are the reference's: rows and columns are drawn per tree, leaves
shrink by an L2 penalty, a child needs a curvature of ``least``.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel

from keepwise.operators.trees import Binning, Block, NodeList, Positions, TreeEnsemble, columns_together, mixed, places, share_of

#: training rows of a block: a level across blocks is a Spark job, a level of this many rows in a task takes less
BLOCK_ROWS = 250_000
#: training rows up to which a fit is one block all the same, as its levels in a task take less than their jobs would
WHOLE_ROWS = 1_000_000
#: places of the histogram of several narrow columns together
CODES = 1024
#: gradients and curvatures are whole numbers of this size
UNIT = float(1 << 20)
#: rounds after which the lineage of the margins is cut
CUT_EVERY = 20


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 400
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.9
    columns: float = 0.9
    l2: float = 1.0
    least: float = 1.0
    seed: int = 42


class Growing(NodeList):
    """A tree of a round: its open nodes by place in the level, gains by feature."""

    def __init__(self, slots: int):
        super().__init__()
        self.open = [self.add()]
        self.gain, self.used = np.zeros(slots), np.zeros(slots)

    def grow(self, splits: list, settings: BoostSettings) -> bool:
        """Takes a level's splits, one for each open node; says whether a level is to follow."""
        following = []
        for node, (total, split) in zip(self.open, splits):
            self.value[node] = _leaf(*total, settings)
            if split is not None:
                gain, slot, column, cut, equal, left_sums = split
                left = self.split(node, column, cut, equal)
                self.value[left] = _leaf(*left_sums, settings)
                self.value[left + 1] = _leaf(total[0] - left_sums[0], total[1] - left_sums[1], settings)
                self.gain[slot] += gain
                self.used[slot] += 1
                following += [left, left + 1]
        self.open = following
        return bool(following)


def _leaf(gradient: float, curvature: float, settings: BoostSettings) -> float:
    return -settings.rate * (gradient / UNIT) / (curvature / UNIT + settings.l2)


def level_sums(block: Block, tree: Growing, turn: int, positions: Positions, settings: BoostSettings) -> np.ndarray:
    """(gradient and curvature, open node, position) of a block's rows that the tree of this round draws."""
    drawn = share_of(mixed(mixed(block.key, settings.seed), turn)) < settings.rows
    at = places(tree, block.bins)
    number = np.full(len(tree.column), -1)
    number[tree.open] = np.arange(len(tree.open))
    rows = np.flatnonzero(drawn & (number[at] >= 0))
    p = 1 / (1 + np.exp(-block.margin[rows]))
    sums = [np.rint((p - block.y[rows]) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT)]
    return positions.histogram(block.bins[rows], number[at[rows]], len(tree.open), sums)


def best_splits(sums: np.ndarray, turn: int, positions: Positions, settings: BoostSettings) -> list:
    """Of each node its total and its best split: (gain, slot, column, cut, equal, sums to the left), or None."""
    first = slice(positions.start[0], positions.start[1] if len(positions.start) > 1 else None)
    total = sums[:, :, first].sum(axis=2)
    left = positions.left(sums)
    right = total[:, :, None] - left
    score = lambda s: (s[0] / UNIT) ** 2 / (s[1] / UNIT + settings.l2)
    gain = (score(left) + score(right) - score(total)[:, None]) / 2
    order = np.argsort(mixed(mixed(np.arange(positions.slots), settings.seed + 1), turn))
    drawn = np.zeros(positions.slots + 1, bool)  # the last one stands for no slot
    drawn[order[:max(1, int(settings.columns * positions.slots))]] = True
    allowed = drawn[positions.slot] & (left[1] >= settings.least * UNIT) & (right[1] >= settings.least * UNIT)
    gain = np.where(allowed, gain, 0.0)
    out = []
    for node, at in enumerate(gain.argmax(axis=1).tolist()):
        split = None
        if gain[node, at] > 1e-6:
            split = (float(gain[node, at]), int(positions.slot[at]), int(positions.column[at]), int(positions.cut[at]),
                     bool(positions.equal[at]), (float(left[0, node, at]), float(left[1, node, at])))
        out.append(((float(total[0, node]), float(total[1, node])), split))
    return out


def _rounds(fits: list[int], settings: BoostSettings, slots: int, level: Callable, finish: Callable) -> dict[int, list[Growing]]:
    """The rounds of ``fits``: ``level`` finds a level's splits, ``finish`` adds a round's trees to the margins."""
    out: dict[int, list[Growing]] = {f: [] for f in fits}
    for turn in range(settings.rounds):
        trees = {f: Growing(slots) for f in fits}
        growing = dict(trees)
        for _ in range(settings.depth):
            found = level(growing, turn)
            growing = {f: t for f, t in growing.items() if t.grow(found[f], settings)}
            if not growing:
                break
        finish(trees)
        for f in fits:
            out[f].append(trees[f])
    return out


def _moved(block: Block, tree: Growing) -> Block:
    tree = tree.nodes()
    return Block(block.fit, block.key, block.y, block.bins, block.margin + tree.value[places(tree, block.bins)])


def _base(positives: int, rows: int) -> float:
    """The log odds all margins start from."""
    share = min(max(positives / max(rows, 1), 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def boost(blocks: RDD, fits: int, parts: int, binning: Binning, settings: BoostSettings = BoostSettings()) -> list[TreeEnsemble]:
    """The boosted trees of each of ``fits`` fits, whose rows lie in ``parts`` blocks each (``blocks_of``)."""
    positions = Positions.of(binning)
    if parts == 1:
        done = blocks.map(lambda b: _in_place(b, positions, settings)).collect()
    else:
        grown, bases = _across(blocks, list(range(fits)), positions, settings)
        done = [(f, bases[f], trees) for f, trees in grown.items()]
    out = []
    for _, base, trees in sorted(done, key=lambda x: x[0]):
        gain, used = sum(t.gain for t in trees), sum(t.used for t in trees)
        out.append(TreeEnsemble.of("boosting", binning, [t.nodes() for t in trees], base, gain / np.maximum(used, 1)))
    return out


def _in_place(block: Block, positions: Positions, settings: BoostSettings) -> tuple[int, float, list[Growing]]:
    """A fit whose rows are this block."""
    base = _base(int(block.y.sum()), len(block.y))
    at = [Block(block.fit, block.key, block.y, block.bins, np.full(len(block.y), base))]
    codes = _Codes(block, positions, settings)

    round_: list[_Round] = []

    def level(trees: dict[int, Growing], turn: int) -> dict[int, list]:
        tree = trees[block.fit]
        if len(tree.column) == 1:
            round_[:] = [_Round(at[0], turn, positions, settings, codes)]
        return {block.fit: best_splits(round_[0].sums(tree), turn, positions, settings)}

    def finish(trees: dict[int, Growing]) -> None:
        at[0] = round_[0].moved(trees[block.fit])

    return block.fit, base, _rounds([block.fit], settings, positions.slots, level, finish)[block.fit]


class _Codes:
    """A fit's rows as its rounds read them: bins column by column, and codes of several narrow columns together,
    so that a level takes fewer histograms."""

    def __init__(self, block: Block, positions: Positions, settings: BoostSettings):
        self.positions, self.seeded = positions, mixed(block.key, settings.seed)
        self.columns = np.ascontiguousarray(block.bins.T.astype(positions.narrow))
        self.together = columns_together(list(range(len(positions.widths))), positions.widths, CODES)
        self.shapes = [[positions.widths[c] for c in g] for g in self.together]
        self.codes = [np.ravel_multi_index([self.columns[c] for c in g], shape).astype(np.uint16) for g, shape in zip(self.together, self.shapes)]

    def sums(self, weights: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
        """(weights, positions): sums of each weight over ``rows`` (default: all), whole numbers below 2**53."""
        out = np.zeros((len(weights), len(self.positions.column)))
        weights = weights if rows is None else [w.take(rows) for w in weights]
        for g, shape, code in zip(self.together, self.shapes, self.codes):
            code = (code if rows is None else code.take(rows)).astype(np.int64)
            cells = [np.bincount(code, w, int(np.prod(shape))).reshape(shape) for w in weights]
            for i, c in enumerate(g):
                start = self.positions.start[c]
                for have, x in zip(out, cells):
                    have[start:start + shape[i]] = x.sum(axis=tuple(j for j in range(len(g)) if j != i))
        return out


class _Round:
    """``level_sums`` of a round's levels in turn, for a block that is a fit: each node has its rows, which go down a step
    a level, and of two siblings the one with more rows has what the other leaves of the parent (whole numbers, so
    exactly its sums). Rows that the round does not draw go along and weigh nothing."""

    def __init__(self, block: Block, turn: int, positions: Positions, settings: BoostSettings, codes: _Codes | None = None):
        self.block, self.codes = block, codes or _Codes(block, positions, settings)
        drawn = share_of(mixed(self.codes.seeded, turn)) < settings.rows
        p = 1 / (1 + np.exp(-block.margin))
        self.weights = [np.rint((p - block.y) * UNIT) * drawn, np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT) * drawn]
        self.rows: dict[int, np.ndarray | None] = {0: None}  # of the nodes that have no children yet, None for all
        self.have: dict[int, np.ndarray] = {}  # the last level's sums

    def sums(self, tree: Growing) -> np.ndarray:
        if not self.have:
            self.have = {0: self.codes.sums(self.weights)}
        else:
            self._down(tree)
            parents, self.have = self.have, {}
            for left in tree.open[::2]:
                fewer, more = sorted((left, left + 1), key=lambda node: len(self.rows[node]))
                self.have[fewer] = self.codes.sums(self.weights, self.rows[fewer])
                self.have[more] = parents[tree.left.index(left)] - self.have[fewer]
        return np.stack([self.have[node] for node in tree.open], axis=1)

    def _down(self, tree: Growing) -> None:
        for node in [n for n in self.rows if tree.column[n] >= 0]:
            rows, bins, cut, left = self.rows.pop(node), self.codes.columns[tree.column[node]], tree.cut[node], tree.left[node]
            b = bins if rows is None else bins.take(rows)
            right = b != cut if tree.equal[node] else b > cut
            for child, own in ((left, ~right), (left + 1, right)):
                self.rows[child] = np.flatnonzero(own) if rows is None else rows[own]

    def moved(self, tree: Growing) -> Block:
        """The block with the tree's values in its margins."""
        self._down(tree)
        added = np.zeros(len(self.block.y))
        for node, rows in self.rows.items():
            added[slice(None) if rows is None else rows] = tree.value[node]
        return Block(self.block.fit, self.block.key, self.block.y, self.block.bins, self.block.margin + added)


def _across(blocks: RDD, fits: list[int], positions: Positions, settings: BoostSettings) -> tuple[dict, dict]:
    """Fits of many blocks: a job per level for all fits, margins kept beside the rows."""
    counts = blocks.map(lambda b: (b.fit, (int(b.y.sum()), len(b.y)))).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collectAsMap()
    bases = {f: _base(*counts[f]) for f in fits}
    state = blocks.map(lambda b: Block(b.fit, b.key, b.y, b.bins, np.full(len(b.y), bases[b.fit]))).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [state]
    rounds = [0]

    def level(trees: dict[int, Growing], turn: int) -> dict[int, list]:
        sums = kept[-1].filter(lambda b: b.fit in trees).map(lambda b: (b.fit, level_sums(b, trees[b.fit], turn, positions, settings)))
        found = sums.reduceByKey(np.add, len(trees)).mapValues(lambda s: best_splits(s, turn, positions, settings)).collectAsMap()
        while len(kept) > 1:  # the newest margins are there now
            kept.pop(0).unpersist()
        return found

    def finish(trees: dict[int, Growing]) -> None:
        rounds[0] += 1
        moved = kept[-1].map(lambda b: _moved(b, trees[b.fit])).persist(StorageLevel.MEMORY_AND_DISK)
        if rounds[0] % CUT_EVERY == 0:
            moved.checkpoint()
        kept.append(moved)

    try:
        return _rounds(fits, settings, positions.slots, level, finish), bases
    finally:
        for rdd in kept:
            rdd.unpersist()
