"""Numeric helpers with engine-independent results."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column, digits: int) -> Column:
    """NumPy-style rounding: rint(x * 10^d) / 10^d, ties to even.

    Written with IEEE primitives (multiply, floor, subtract, divide) so that
    any engine evaluating the same steps gets the same bits.
    """
    scale = F.lit(float(10 ** digits))
    r = x * scale
    f = F.floor(r).cast("double")
    d = r - f
    up = f + F.lit(1.0)
    even = F.when(F.pmod(f, F.lit(2.0)) == 0, f).otherwise(up)
    rounded = F.when(d > 0.5, up).when(d < 0.5, f).otherwise(even)
    return rounded / scale


def sql_round_half_even(expr: str, digits: int) -> str:
    """The same steps as SQL text for the DuckDB oracle."""
    s = f"CAST({10 ** digits} AS DOUBLE)"
    r = f"(({expr}) * {s})"
    f = f"CAST(FLOOR({r}) AS DOUBLE)"
    return (
        f"(CASE WHEN {r} - {f} > 0.5 THEN {f} + 1.0 WHEN {r} - {f} < 0.5 THEN {f} "
        f"WHEN ({f}) - 2.0 * FLOOR(({f}) / 2.0) = 0 THEN {f} ELSE {f} + 1.0 END) / {s}"
    )
