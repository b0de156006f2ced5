"""Sessions and frames by range over events, split inside a hot key.

A key with a third of all events is cut by the clock into buckets, so no task
sorts it whole. A cut between two events depends on the event before alone,
which is in the same bucket or the last one of an earlier bucket: one row per
key and bucket is carried over. A frame that looks back a fixed time reads the
event's own bucket and the one before.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.operators.joins import fresh

HOUR = 3600


def _micros(df: DataFrame, time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def with_sessions(df: DataFrame, key: str, time: str, gap_seconds: int = 30 * 60, order: list[str] | None = None,
                  bucket_seconds: int = 24 * HOUR) -> DataFrame:
    """``df`` with ``session`` (from 1, per key) and ``gap`` (seconds since the
    event before, null for the first).

    A gap of more than ``gap_seconds`` starts a session. Events of one time go
    by ``order`` (default: all columns). Rows without a key or a time are left out.
    """
    own = df.columns
    at, bucket, opens, prior, upto = (fresh(n, [*own, "session", "gap"]) for n in ("__at", "__bucket", "__opens", "__prior", "__upto"))
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(at, _micros(df, time))
    rows = rows.withColumn(bucket, F.floor(F.col(at) / F.lit(bucket_seconds * 1_000_000)))
    ties = [F.col(c) for c in (order or own)]
    ends = rows.groupBy(key, bucket).agg(F.max(at).alias(upto))
    over_buckets = Window.partitionBy(key).orderBy(bucket)
    carried = ends.select(key, bucket, F.lag(upto).over(over_buckets).alias(prior))
    within = Window.partitionBy(key, bucket).orderBy(at, *ties)
    before = F.coalesce(F.lag(at).over(within), F.col(prior))
    joined = rows.join(carried, [key, bucket]).withColumn(prior, before)
    cut = F.col(prior).isNull() | (F.col(at) - F.col(prior) > F.lit(gap_seconds * 1_000_000))
    marked = joined.withColumn(opens, cut.cast("long"))
    counts = marked.groupBy(key, bucket).agg(F.sum(opens).alias(upto))
    earlier = counts.select(key, bucket, F.coalesce(
        F.sum(upto).over(over_buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(upto))
    running = F.sum(opens).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(earlier, [key, bucket]).select(
        *own, (F.col(upto) + running).alias("session"), ((F.col(at) - F.col(prior)) / 1_000_000).alias("gap"))


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int = 30 * 60, value: str | None = None, **options) -> DataFrame:
    """A row per session: key, session, started, ended, events and, of ``value``, its sum in cents."""
    cut = with_sessions(df, key, time, gap_seconds, **options)
    total = [F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total")] if value else []
    return cut.groupBy(key, "session").agg(F.min(time).alias("started"), F.max(time).alias("ended"),
                                           F.count(F.lit(1)).alias("events"), *total)


def look_back(df: DataFrame, key: str, time: str, seconds: int, value: str) -> DataFrame:
    """``df`` with ``recent_events`` and ``recent_total``: the events of the key in
    the last ``seconds`` up to and with the event's own time, and their sum in cents.

    Time is cut into buckets of that length: an event's frame lies in its own
    and the one before. Each bucket's rows are given to the next one too, where
    they are only read.
    """
    own = df.columns
    at, bucket, copy, cents = (fresh(n, [*own, "recent_events", "recent_total"]) for n in ("__at", "__bucket", "__copy", "__cents"))
    width = seconds * 1_000_000
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(at, _micros(df, time))
    rows = rows.withColumn(cents, F.col(value).cast("decimal(18,2)"))
    first = F.floor(F.col(at) / F.lit(width))
    given = rows.select("*", F.posexplode(F.array(first, first + 1)).alias(copy, bucket))
    frame = Window.partitionBy(key, bucket).orderBy(at).rangeBetween(-width, 0)
    seen = given.withColumns({"recent_events": F.count(F.lit(1)).over(frame), "recent_total": F.sum(cents).over(frame).cast("double")})
    return seen.where(F.col(copy) == 0).select(*own, "recent_events", "recent_total")
