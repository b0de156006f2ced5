"""Periodic run detection (operator 13): maximal repetitions of words.

Words become integers. At scale ``b`` (2, 4, 8, ...) the text is cut into
blocks of ``b`` words; a run of period ``q`` from ``2b`` to ``4b - 1`` (from 1
at the first scale) holds a whole block and its copy ``q`` words later. For
each block an integer number-theoretic transform gives, for all those
distances at once, the sum of squared differences between the block and what
follows; where it is zero the block occurs again, and that distance seeds an
extension to the longest stretch that keeps the period. Sums are exact
modulo a prime; the extension compares the words themselves, so a sum that is
zero only modulo the prime leaves no run.

Two exact tests spare transforms: a block with a word that does not occur
again within ``4b`` words has no copy, and distances within a run of period at
most ``b`` only lead to that run again.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keepwise.llm.common import in_slices, utf8

#: a prime with roots of unity of all orders up to 2**27, and a generator
PRIME, GENERATOR = 2013265921, 31
#: numbers transformed at a time
CHUNK = 1 << 18
#: words compared at once on either side of all seeds, before the rest go on alone
FIRST_LOOK = 16

Run = tuple[int, int, int]  # start, length, period


@lru_cache(maxsize=64)
def _stages(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each stage of a transform of ``size`` numbers."""
    out, n = [], size
    while n > 1:
        root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        root = pow(root, PRIME - 2, PRIME) if inverse else root
        powers = np.ones(n // 2, np.uint64)
        have = 1
        while have < n // 2:  # w^(have + i) = w^i * w^have
            powers[have:2 * have] = powers[:have] * np.uint64(pow(root, have, PRIME)) % np.uint64(PRIME)
            have *= 2
        out.append(powers[:, None])
        n //= 2
    return out


def ntt(columns: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The transform of each column (a power of two of residues), in natural order."""
    size, count = columns.shape
    p = np.uint64(PRIME)
    x = columns.astype(np.uint64)
    for powers in _stages(size, inverse):
        half = len(powers)
        x = x.reshape(2 * half, -1)
        low, high = x[:half], x[half:]
        y = np.empty((half, 2, x.shape[1]), np.uint64)  # results interleave, so that no reordering is left
        total = low + high
        y[:, 0] = np.minimum(total, total - p)  # below p, total - p wraps round to a large number
        y[:, 1] = (low + p - high) * powers % p
        x = y
    x = x.reshape(size, count)
    return x * np.uint64(pow(size, PRIME - 2, PRIME)) % p if inverse else x


def _zero_distances(ids: np.ndarray, squares: np.ndarray, at: np.ndarray, b: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of blocks ``at`` of ``b`` words that occur again at a distance in [low, high).

    ``ids`` are padded with zeros, ``squares`` are running sums of their squares.
    """
    span = high - low + b - 1
    size = 1 << (span - 1).bit_length()
    lags = np.arange(low, high)[:, None]
    starts, distances = [], []
    step = max(1, CHUNK // size)
    for i in range(0, len(at), step):
        x = at[i:i + step]
        turned = np.zeros((size, len(x)), np.int64)  # reversed, which makes the convolution a correlation
        turned[-np.arange(b)] = ids[x + np.arange(b)[:, None]]
        after = np.zeros((size, len(x)), np.int64)
        after[:span] = ids[x + low + np.arange(span)[:, None]]
        product = ntt(ntt(turned) * ntt(after) % np.uint64(PRIME), inverse=True)[:high - low].astype(np.int64)
        begin = x + lags
        sums = squares[x + b] - squares[x] + squares[begin + b] - squares[begin]
        lag, block = np.nonzero((sums - 2 * product) % PRIME == 0)
        starts.append(x[block])
        distances.append(lag + low)
    return np.concatenate(starts), np.concatenate(distances)


def _stretch(ids: np.ndarray, x: int, q: int) -> tuple[int, int]:
    """The longest [s, e) around ``x`` with ids[i] == ids[i + q] for all its i."""
    last, step, e = len(ids) - q, 64, x
    while e < last:
        to = min(last, e + step)
        differ = ids[e:to] != ids[e + q:to + q]
        if differ.any():
            e += int(differ.argmax())
            break
        e, step = to, step * 2
    s, step = x, 64
    while s > 0:
        to = max(0, s - step)
        differ = (ids[to:s] != ids[to + q:s + q])[::-1]
        if differ.any():
            s -= int(differ.argmax())
            break
        s, step = to, step * 2
    return s, e


def _worth_extending(ids: np.ndarray, x: np.ndarray, q: np.ndarray, least: int) -> np.ndarray:
    """Seeds whose stretch is still open, or long enough, after a look at a few words on both sides."""
    n, length = len(ids), np.zeros(len(x), np.int64)
    unsettled = np.zeros(len(x), bool)
    for step in (1, -1):
        going = np.ones(len(x), bool)
        for k in range(FIRST_LOOK):
            i = x + k if step > 0 else x - 1 - k
            inside = (i >= 0) & (i + q < n)
            safe = np.where(inside, i, 0)
            going &= inside & (ids[safe] == ids[np.where(inside, i + q, 0)])
            length += going
        unsettled |= going
    return unsettled | (length >= np.maximum(least - q, q))


def runs_of(ids: np.ndarray, least: int = 12) -> list[Run]:
    """All maximal repetitions of ``ids`` (from 0, below the prime) of at least ``least``
    words and two periods: (start, length, smallest period), by start, then period.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    again = np.full(n, 2 * n, np.int64)  # distance to the next occurrence of the same word
    same = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    again[order[same]] = order[same + 1] - order[same]
    values = ids.astype(np.int64) + 1
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period, which comes first
    reach = np.zeros(n + 1, np.int64)  # the furthest end of a run from here of period b at most
    waiting: list[Run] = []  # runs of larger periods
    # a run has max(least - q, q) words that occur again q later: any 2b - 1 of them hold a block
    b, low = 2 if least >= 5 else 1, 1
    worst = np.maximum.reduceat(again, np.arange(0, n, b)) if n else again
    padded = squares = np.zeros(0, np.int64)
    while 2 * low <= n:
        high = 4 * b
        if len(padded) < n + 8 * b:
            padded = np.concatenate([values, np.zeros(max(n, 16 * b), np.int64)])
            squares = np.concatenate([[0], np.cumsum(padded * padded % PRIME)])
        for s, length, q in (r for r in waiting if r[2] <= b):
            reach[s] = max(reach[s], s + length)
        waiting = [r for r in waiting if r[2] > b]
        known = np.maximum.accumulate(reach)
        at = np.flatnonzero(worst < high) * b
        at = at[(at + b + low <= n) & (known[np.minimum(at, n)] < at + high + b)]
        for s, e, q in _extended(ids, *_new_seeds(padded, squares, known, at, n, b, low, high), least):
            if (s, e) not in found:
                found[s, e] = q
                waiting.append((s, e - s, q))
        b, low = 2 * b, high
        worst = np.append(worst, [0] * (len(worst) % 2)).reshape(-1, 2).max(axis=1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _new_seeds(padded, squares, known, at, n: int, b: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds (start, distance), without those that only lead to a known run again.

    Two stretches of periods q0 <= b and q that share q + b words have a period
    that divides both, so the second is no run of smallest period q.
    """
    if not len(at):
        return at, at
    x, q = _zero_distances(padded, squares, at, b, low, high)
    new = (x + q + b <= n) & (known[x] < x + q + b)
    return x[new], q[new]


def _extended(ids: np.ndarray, x: np.ndarray, q: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the stretches around seeds that are long enough, by period."""
    if len(x):
        worth = _worth_extending(ids, x, q, least)
        x, q = x[worth], q[worth]
    period, seen = 0, 0
    for i in np.lexsort((x, q)).tolist():
        at, now = int(x[i]), int(q[i])
        if now == period and at < seen:
            continue  # in the stretch before
        s, e = _stretch(ids, at, now)
        period, seen = now, e
        if e + now - s >= max(least, 2 * now):
            yield s, e + now, now


def collapsed(length: int, runs: list[Run]) -> np.ndarray:
    """The places kept of ``length`` words: a word after the first period of a run goes."""
    edge = np.zeros(length + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = 12,
              batch_bytes: int = 8 << 20) -> DataFrame:
    """``keep`` columns (default: all) of ``docs``, with the runs of each whole text.

    n_words, runs (array of start, length, period; words numbered from 0, by
    start, then period) and collapsed (the words kept, joined by one space:
    of each run its first period stays, unless another run takes it).
    New columns replace kept ones of the same name.

    Null, empty and blank texts have no word and no run. Equal rows are judged
    one by one; an empty table gives no row. A text is searched whole, in
    memory of some hundred bytes a word; texts of about ``batch_bytes`` are
    searched together, each with integers of its own, so none meets another.
    """
    new = T._parse_datatype_string("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    source = next(f"__text{i}" for i in range(len(kept) + 1) if f"__text{i}" not in kept)
    out = T.StructType([docs.schema[c] for c in kept] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new.fields]
        for batch in batches:
            for part in in_slices(batch, source, batch_bytes):
                texts = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in part.column(source)]
                rows = list(_searched(texts, least))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                    names=kept + new.names)

    return docs.select(*kept, utf8(text).alias(source)).mapInArrow(run, out)


def _searched(texts: list[list[bytes]], least: int) -> Iterator[tuple]:
    """n_words, runs and collapsed text of each list of words, searched as one sequence.

    Words of different texts get different integers and a wall stands between
    texts: no run holds a number that occurs once.
    """
    numbered, starts, size, top = [], [], 0, 0
    for words in texts:
        own = {w: top + i for i, w in enumerate(dict.fromkeys(words))}
        top += len(own) + 1
        numbered.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
        numbered.append(np.array([top - 1]))
        starts.append(size)
        size += len(words) + 1
    runs = runs_of(np.concatenate(numbered) if numbered else np.zeros(0, np.int64), least)
    at = 0
    for words, start in zip(texts, starts):
        own_runs = []
        while at < len(runs) and runs[at][0] < start + len(words):
            s, length, q = runs[at]
            own_runs.append((s - start, length, q))
            at += 1
        left = [words[i] for i in collapsed(len(words), own_runs).tolist()] if own_runs else words
        yield len(words), [dict(zip(("start", "length", "period"), r)) for r in own_runs], b" ".join(left).decode("utf-8", "replace")
