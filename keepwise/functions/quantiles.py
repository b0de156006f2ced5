"""Exact quantiles (linear interpolation) without pulling a column into one task.

``percentile`` merges a map of every distinct value in the final task, which
does not hold for billions of rows. Here a wanted rank is narrowed by ranks,
not by values: a pass summarises each open range by some thousand approximate
quantiles (a sketch of bounded size, merged map-side), the next one counts,
exactly, the rows at and between them, and only the gaps that hold a wanted
rank stay open. A range so shrinks about a thousandfold in two passes whatever
the values; a rank on a cut is found at once, so a hot value ends it. Only
sketches and counts reach the driver, at every size.

Interpolation follows ``quantile_cont``: position h = (n - 1) * p,
d = h - floor h, value = x[floor h] * (1 - d) + x[ceil h] * d with the first
product fused (one rounding), which is how the SQL engine used as oracle
evaluates it; mathematically the usual linear interpolation.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.functions.places import numbers, place

#: approximate quantiles a pass asks for; their rank error is a tenth of their distance
GRID = 1000


@dataclass
class Summary:
    """What a pass finds in a range: rows, least and greatest value, approximate quantiles."""
    n: int
    lo: float
    hi: float
    cuts: list[float]


@dataclass(frozen=True)
class _Open:
    """The values of a group strictly between two others, with the rows at or below the lower one."""
    cid: int
    lo: float
    hi: float
    base: int


def _long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    """(cid, v) for every non-null, non-NaN value of the listed columns."""
    if len(cols) == 1:
        out = df.select(F.lit(0).alias("cid"), F.col(cols[0]).cast("double").alias("v"))
    else:
        pairs = F.array(*[
            F.struct(F.lit(i).alias("cid"), F.col(c).cast("double").alias("v"))
            for i, c in enumerate(cols)
        ])
        out = df.select(F.inline(pairs))
    return out.where(F.col("v").isNotNull() & ~F.isnan("v"))


def _summary(v: Column, grid: int) -> list[Column]:
    # one literal: a thousand of them in each of many aggregates would take longer than small queries
    points = F.split(F.lit(",".join(repr(i / grid) for i in range(grid + 1))), ",").cast("array<double>")
    return [F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
            F.percentile_approx(v, points, 10 * grid).alias("cuts")]


def group_stats(long: DataFrame, grid: int = GRID) -> dict[int, Summary]:
    """The first pass: a summary per group of a long (cid, v) table (few groups)."""
    rows = long.groupBy("cid").agg(*_summary(F.col("v"), grid)).collect()
    return {r["cid"]: Summary(r["n"], r["lo"], r["hi"], list(r["cuts"])) for r in rows}


def select_ranks(
    long: DataFrame,
    wanted: dict[int, set[int]],
    stats: dict[int, Summary],
    *,
    grid: int = GRID,
) -> dict[tuple[int, int], tuple[float, int]]:
    """Values at 0-based ranks inside groups of a long (cid, v) table.

    Returns ``(cid, rank) -> (value, rows of the group strictly below value)``.
    All ranks share their passes. One pass counts, exactly, the rows equal to
    each cut and between neighbouring ones; the next sketches the few gaps
    that hold a wanted rank, which gives the cuts there.
    """
    found: dict[tuple[int, int], tuple[float, int]] = {}
    ranks = {c: set(r) for c, r in wanted.items() if stats.get(c) and stats[c].n}
    cuts = {(c, -math.inf, math.inf, 0): _edges(stats[c]) for c in ranks}
    while cuts:
        counts = _counts(long, {c: sorted({x for (d, *_), xs in cuts.items() if d == c for x in xs}) for c in {k[0] for k in cuts}})
        gaps: set[_Open] = set()
        for (c, lo, hi, below), xs in cuts.items():
            number = counts[c]
            before = lo
            for x in [*xs, hi]:
                gap = number.get((before, x), 0) if before != x else 0
                inside = {r for r in ranks[c] if below <= r < below + gap}
                if inside:
                    gaps.add(_Open(c, before, x, below))
                below += gap
                equal = number.get((x, x), 0) if x in xs else 0
                for r in [r for r in ranks[c] if below <= r < below + equal]:
                    found[(c, r)] = (x, below)
                    ranks[c].discard(r)
                below += equal
                before = x
        cuts = {}
        for gap, s in _sketches(long, sorted(gaps, key=lambda g: (g.cid, g.lo)), grid).items():
            if s.lo == s.hi:
                for r in [r for r in ranks[gap.cid] if gap.base <= r < gap.base + s.n]:
                    found[(gap.cid, r)] = (s.lo, gap.base)
                    ranks[gap.cid].discard(r)
            else:
                cuts[(gap.cid, gap.lo, gap.hi, gap.base)] = _edges(s)
    return found


def _edges(s: Summary) -> list[float]:
    return sorted({s.lo, s.hi, *s.cuts})


def _counts(long: DataFrame, edges: dict[int, list[float]]) -> dict[int, dict[tuple[float, float], int]]:
    """Rows of each group equal to an edge (x, x) and between neighbouring edges (x, y)."""
    cell = F.lit(None).cast("int")
    for c, xs in edges.items():
        at = place(F.col("v"), xs)
        equal = F.get(numbers(xs), at - 1) == F.col("v")
        cell = F.when(F.col("cid") == c, F.when(F.coalesce(equal, F.lit(False)), 2 * at - 1).otherwise(2 * at)).otherwise(cell)
    out: dict[int, dict[tuple[float, float], int]] = {c: {} for c in edges}
    rows = long.where(F.col("cid").isin(*edges)).groupBy("cid", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    for r in rows.collect():  # twice the edges at most
        xs, i = [-math.inf, *edges[r["cid"]], math.inf], (r["cell"] + 1) // 2
        out[r["cid"]][(xs[i], xs[i]) if r["cell"] % 2 else (xs[i], xs[i + 1])] = r["n"]
    return out


def _sketches(long: DataFrame, gaps: list[_Open], grid: int) -> dict[_Open, Summary]:
    """A summary of each gap."""
    if not gaps:
        return {}
    which = F.lit(None).cast("int")
    for c in {g.cid for g in gaps}:
        own = [(i, g) for i, g in enumerate(gaps) if g.cid == c]
        at = place(F.col("v"), [g.lo for _, g in own])
        inside = (F.get(numbers([g.lo for _, g in own]), at - 1) < F.col("v")) & (F.get(numbers([g.hi for _, g in own]), at - 1) > F.col("v"))
        which = F.when(F.col("cid") == c, F.when(inside, at - 1 + own[0][0])).otherwise(which)
    marked = long.select("v", which.alias("gap")).where(F.col("gap").isNotNull())
    rows = marked.groupBy("gap").agg(*_summary(F.col("v"), grid)).collect()
    return {gaps[r["gap"]]: Summary(r["n"], r["lo"], r["hi"], list(r["cuts"])) for r in rows}


def _lerp(lo: float, hi: float, d: float) -> float:
    fma = getattr(math, "fma", None)
    if fma is None:   # Python < 3.13
        return lo * (1 - d) + hi * d
    return fma(lo, 1 - d, hi * d)


def exact_quantiles(
    df: DataFrame,
    specs: dict[str, list[float]],
    *,
    grid: int = GRID,
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles for several columns in shared passes.

    ``specs`` maps a column name to the probabilities wanted. Returns, per
    column, the values in the same order; ``None`` when the column has no
    non-missing values.
    """
    cols = list(specs)
    # every pass reads the narrow (column, value) table: keep it for the
    # duration of the search instead of recomputing the input per pass
    long = _long_form(df, cols).persist()
    try:
        return _quantiles_from(long, cols, specs, grid)
    finally:
        long.unpersist()


def _quantiles_from(long: DataFrame, cols: list[str], specs: dict[str, list[float]],
                    grid: int) -> dict[str, list[float | None]]:
    stats = group_stats(long, grid)
    plan: dict[int, list[tuple[int, int, float]]] = {}
    wanted: dict[int, set[int]] = {}
    for cid, c in enumerate(cols):
        if cid not in stats:
            continue
        n = stats[cid].n
        plan[cid], wanted[cid] = [], set()
        for p in specs[c]:
            h = (n - 1) * float(p)
            f_rank, c_rank = math.floor(h), math.ceil(h)
            plan[cid].append((f_rank, c_rank, h - f_rank))
            wanted[cid].update({f_rank, c_rank})
    found = select_ranks(long, wanted, stats, grid=grid)

    out: dict[str, list[float | None]] = {}
    for cid, c in enumerate(cols):
        if cid not in plan:
            out[c] = [None] * len(specs[c])
            continue
        vals = []
        for f_rank, c_rank, frac in plan[cid]:
            lo_v, hi_v = found[(cid, f_rank)][0], found[(cid, c_rank)][0]
            vals.append(lo_v if f_rank == c_rank else _lerp(lo_v, hi_v, frac))
        out[c] = vals
    return out


def medians(df: DataFrame, cols: list[str], **kw) -> dict[str, float | None]:
    res = exact_quantiles(df, {c: [0.5] for c in cols}, **kw)
    return {c: v[0] for c, v in res.items()}


def approx_quantiles(df: DataFrame, specs: dict[str, list[float]], accuracy: int = 100_000):
    """``percentile_approx`` variant: one pass, relative rank error 1/accuracy."""
    row = df.agg(*[
        F.percentile_approx(F.col(c).cast("double"), [float(p) for p in ps], accuracy).alias(c)
        for c, ps in specs.items()
    ]).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(specs[c]) for c in specs}
