"""Running totals over a global order, computed in parallel.

A window with ``orderBy`` and no ``partitionBy`` sorts everything in one task.
Here rows are range-partitioned by the order (Spark samples the bounds) and
written once, with their partition's number, to the shared folder: bounds that
come from a sample must not be drawn twice. Running sums are then taken inside
each range (a window partitioned by its number), each range is totalled, and
the totals, a row per range, become offsets that are added back.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.functions.staging import staged


def running_totals(
    df: DataFrame,
    order: list[str | Column],
    values: dict[str, Column],
    *,
    partitions: int | None = None,
    restart_by: list[str] | None = None,
) -> DataFrame:
    """Add inclusive running sums ``values`` (name -> expression) along ``order``:
    column names (ascending) or ``F.asc`` and ``F.desc`` columns.

    ``order`` must be a total order on the rows; ties would make the running
    value of tied rows depend on their physical order. Missing keys come first
    ascending and last descending, as in ``asc()`` and ``desc()``.

    ``restart_by`` restarts the sums per group for a *few* large groups (folds,
    classes): the groups lead the global order and each group's start offset
    (one row per group, from the staged copy) is subtracted. Many small groups
    should use a window partitioned by the group instead.
    """
    spark = df.sparkSession
    sort = [F.asc(c) for c in restart_by or []] + [F.asc(o) if isinstance(o, str) else o for o in order]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    valued = df.select("*", *[v.alias(f"__v_{k}") for k, v in values.items()])
    rows = staged(valued.repartitionByRange(n, *sort).withColumn("__b", F.spark_partition_id()), "running")

    w_local = Window.partitionBy("__b").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(f"__v_{k}").over(w_local).alias(f"__l_{k}") for k in values])
    totals = rows.groupBy("__b").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in values])
    out = local.join(F.broadcast(_offsets(totals, ["__b"], values, "__o")), "__b")   # a row per range: n at most
    plus = {k: F.col(f"__o_{k}") + F.col(f"__l_{k}") for k in values}
    if restart_by:
        totals = rows.groupBy(*restart_by).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in values])
        out = out.join(_offsets(totals, restart_by, values, "__s"), restart_by)
        plus = {k: c - F.col(f"__s_{k}") for k, c in plus.items()}
    return out.select(*[F.col(c) for c in df.columns], *[c.alias(k) for k, c in plus.items()])


def _offsets(totals: DataFrame, by: list[str], values: dict[str, Column], prefix: str) -> DataFrame:
    """Sums of all groups before each, on a small table."""
    w = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, *[F.coalesce(F.sum(f"__t_{k}").over(w), F.lit(0)).alias(f"{prefix}_{k}") for k in values])
