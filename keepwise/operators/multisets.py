"""Multiset operations and the difference of two snapshots, each in one shuffle.

Rows are compared whole; NULL equals NULL and NaN equals NaN. Equal rows are
counted before the shuffle, so a row that makes up a third of a table is one
row per task.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.operators.joins import fresh


def _counted(left: DataFrame, right: DataFrame) -> tuple[DataFrame, str, str]:
    """Distinct rows of both sides with their numbers on each."""
    columns = left.columns
    if columns != right.columns:
        raise ValueError(f"columns differ: {columns} and {right.columns}")
    a, b = fresh("__a", columns), fresh("__b", columns)
    both = left.select("*", F.lit(1).alias(a), F.lit(0).alias(b)).union(right.select("*", F.lit(0).alias(a), F.lit(1).alias(b)))
    return both.groupBy(*columns).agg(F.sum(a).alias(a), F.sum(b).alias(b)), a, b


def _repeated(counted: DataFrame, times: Column, columns: list[str]) -> DataFrame:
    n = fresh("__n", columns)
    some = counted.withColumn(n, times).where(F.col(n) > 0)
    return some.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias(n)).select(*columns)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left``, each as often as it is there oftener than in ``right``."""
    counted, a, b = _counted(left, right)
    return _repeated(counted, F.col(a) - F.col(b), left.columns)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, each as often as in the side that has fewer."""
    counted, a, b = _counted(left, right)
    return _repeated(counted, F.least(a, b), left.columns)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that are not equally often on both sides, with ``n_left`` and ``n_right``."""
    counted, a, b = _counted(left, right)
    return counted.where(F.col(a) != F.col(b)).withColumnsRenamed({a: "n_left", b: "n_right"})


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The change feed from ``old`` to ``new``: key, change, changed (names) and the rows as before and after.

    ``change`` is ``added``, ``removed`` or ``changed``; equal rows give none.
    NULL keys are keys like any other. A key has one row in each snapshot;
    more are an error. Columns of one side only are NULL on the other.
    """
    values = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in key]

    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in values])
        return df.select(*key, row.alias(name))

    a, b = side(old, "before"), side(new, "after")
    both = a.unionByName(b, allowMissingColumns=True)
    one = lambda c: F.when(F.count(c) > 1, F.raise_error(F.lit("a key has several rows in a snapshot")).cast(
        both.schema[c].dataType)).otherwise(F.any_value(c, ignoreNulls=True))
    met = both.groupBy(*key).agg(one("before").alias("before"), one("after").alias("after"))
    differ = F.filter(F.array(*[F.when(~F.col("before")[c].eqNullSafe(F.col("after")[c]), F.lit(c)) for c in values]), lambda c: c.isNotNull())
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.size(differ) > 0, "changed")
    out = met.withColumn("change", change).where("change IS NOT NULL")
    return out.select(*key, "change", F.when(F.col("change") == "changed", differ).otherwise(F.array().cast("array<string>")).alias("changed"),
                      "before", "after")


def union_distinct(*tables: DataFrame) -> DataFrame:
    """Distinct rows of all tables."""
    return reduce(DataFrame.unionByName, tables).distinct()
