"""The place of a number among many ascending ones, as an expression."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(values: list[float]) -> Column:
    """A constant array, from one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def place(x: Column, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` are at most x, in two steps of about the root of their number."""
    if not cuts:
        return F.when(x.isNotNull(), F.lit(0))
    step = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    upto = lambda c: c <= x
    part = F.size(F.filter(numbers([p[0] for p in parts]), upto))
    own = F.slice(numbers(cuts), (part - 1) * step + 1, F.lit(step))
    return F.when(x.isNotNull(), F.when(part == 0, 0).otherwise((part - 1) * step + F.size(F.filter(own, upto))))
