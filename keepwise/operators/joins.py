"""As-of and interval joins.

Both cut the line of times into buckets, so that a key with a third of all
rows is many groups: a row looks within its own bucket first, and what a whole
bucket passes on is one row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.functions.places import place


#: buckets of the line of times per shuffle partition
BUCKETS_A_PARTITION = 4


def fresh(prefix: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    name = prefix
    while name in taken:
        name += "_"
    return name


def _line(c: Column, kind: str) -> Column:
    """A time as a number."""
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str] | None = None,
              suffix: str = "_right", order: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """``left`` with, of the ``right`` rows of its ``by`` values, the last one not after its time.

    Right columns (but ``by``) get ``suffix``; they are null where no such row
    is, or where a time is null or NaN. Null ``by`` values meet nothing. Of right rows
    of one time the largest by ``order`` (default: all other columns) counts.

    Both tables meet in one shuffle by key and bucket of time. The last right
    row of each bucket is carried over the buckets of its key, a row each.
    """
    by = by or []
    spark = left.sparkSession
    kinds = dict(left.dtypes)[left_time], dict(right.dtypes)[right_time]
    own = [c for c in right.columns if c not in by]
    ties = order or [c for c in own if c != right_time]
    taken = [*left.columns, *right.columns]
    t, side, payload, bucket, found = (fresh(n, taken) for n in ("__t", "__side", "__payload", "__bucket", "__found"))
    content = F.struct(*left.columns)
    rows = left.select(*[F.col(c).alias(c) for c in by], _line(F.col(left_time), kinds[0]).alias(t), F.lit(1).alias(side),
                       content.alias("__left"))
    keep = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(ties)], *[F.col(c).alias(c) for c in own])
    known = right.where(F.col(right_time).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    held = known.select(*[F.col(c).alias(c) for c in by], _line(F.col(right_time), kinds[1]).alias(t), F.lit(0).alias(side), keep.alias(payload))
    held = held.where(~F.isnan(t))
    buckets = buckets or BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = rows.unionByName(held, allowMissingColumns=True)
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = both.where(~F.isnan(t)).agg(F.percentile_approx(t, shares, 10_000).alias("c")).first()["c"]
    dealt = both.withColumn(bucket, F.coalesce(place(F.col(t), sorted(set(cuts or []))), F.lit(-1)))
    within = Window.partitionBy(*by, bucket).orderBy(F.col(t).asc_nulls_first(), side, payload).rowsBetween(Window.unboundedPreceding, 0)
    latest = dealt.withColumn(found, F.last(payload, ignorenulls=True).over(within))
    ends = dealt.where(F.col(side) == 0).groupBy(*by, bucket).agg(F.max(F.struct(t, payload)).alias("end"))
    steps = dealt.select(*by, bucket).distinct().join(ends, [*by, bucket], "left") if by else dealt.select(bucket).distinct().join(ends, bucket, "left")
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1) if by else \
        Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    carried = steps.select(*by, bucket, F.last(F.col(f"end.{payload}"), ignorenulls=True).over(earlier).alias("carried"))
    asked = latest.where(F.col(side) == 1)
    met = asked.join(carried, [*by, bucket], "left")
    row = F.coalesce(F.col(found), F.col("carried"))
    row = F.when(F.col(t).isNotNull() & ~F.isnan(t), row)
    return met.select("__left.*", *[row[c].alias(c + suffix) for c in own])


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: list[str] | None = None,
                  suffix: str = "_right", width: float | None = None) -> DataFrame:
    """All pairs of ``left`` and ``right`` rows of equal ``by`` values whose closed spans overlap.

    Spans are cut into bins of ``width`` (in days of dates, microseconds of
    timestamps, else in the columns' unit; default: twice the mean length of
    both sides' spans). Rows meet in shared bins, and a pair counts in one of
    them: that of the later start. A span with a null end or an end before its
    start meets nothing. Right columns (but ``by``) get ``suffix``.
    """
    by = by or []
    kinds = {**dict(left.dtypes)}, {**dict(right.dtypes)}
    spans = []
    for df, (a, b), k in ((left, left_span, kinds[0]), (right, right_span, kinds[1])):
        low, high = _line(F.col(a), k[a]), _line(F.col(b), k[b])
        spans.append((df.where((low <= high)), low, high))
    if width is None:
        means = [df.agg(F.avg(high - low)).first()[0] or 0.0 for df, low, high in spans]
        width = max(2 * max(means), 1.0)
    own = [c for c in right.columns if c not in by]
    sides = []
    for (df, low, high), name, cols in zip(spans, ("l", "r"), (left.columns, own)):
        bins = F.sequence(F.floor(low / F.lit(float(width))), F.floor(high / F.lit(float(width))))
        sides.append(df.select(*[F.col(c).alias(f"__by{i}_{name}") for i, c in enumerate(by)], low.alias(f"__{name}0"), high.alias(f"__{name}1"),
                               F.struct(*[F.col(c).alias(c) for c in cols]).alias(f"__{name}"), F.explode(bins).alias(f"__bin_{name}")))
    a, b = sides
    on = F.col("__bin_l") == F.col("__bin_r")
    for i in range(len(by)):
        on = on & (F.col(f"__by{i}_l") == F.col(f"__by{i}_r"))
    overlap = (F.col("__l0") <= F.col("__r1")) & (F.col("__r0") <= F.col("__l1"))
    owner = F.col("__bin_l") == F.floor(F.greatest("__l0", "__r0") / F.lit(float(width)))
    met = a.join(b, on & overlap & owner)
    return met.select("__l.*", *[F.col("__r")[c].alias(c + suffix) for c in own])
