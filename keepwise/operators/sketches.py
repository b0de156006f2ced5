"""Mergeable sketches: distinct customers and quantiles, stored as binary state per group.

A store holds one small state per group (plan and month, say). Any filter over
the groups is answered by merging states, without the rows. Merging is
associative and commutative up to the error bounds, so neither the order of
groups nor a later batch of states matters.

Sets are HyperLogLog sketches: with ``lg`` bits of registers the standard
error is about 1.04 / 2**(lg / 2). Quantiles are KLL sketches: with ``k`` the
rank error is about 2.3 / k**0.9 (99 % of the time, one quantile).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, KLL_K = 12, 400


def set_error(lg: int = LG) -> float:
    """Relative error of a count that three standard errors bound."""
    return 3 * 1.04 / 2 ** (lg / 2)


def rank_error(k: int = KLL_K) -> float:
    return 2.3 / k ** 0.9


def build(df: DataFrame, by: list[str], member: str, value: str, lg: int = LG, k: int = KLL_K) -> DataFrame:
    """by, n, members (set state) and quantiles (quantile state): a row per group.

    NULL members and NULL values are in no state; partial states are built
    before the shuffle, so a large group is a state per task.
    """
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(member).cast("string"), F.lit(lg)).alias("members"),
                               F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("quantiles"))


def merge(states: DataFrame, by: list[str]) -> DataFrame:
    """The states of coarser groups."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("members", F.lit(True)).alias("members"),
                                   F.kll_merge_agg_double("quantiles").alias("quantiles"))


def distinct_members(members: str | Column = "members") -> Column:
    """About how many distinct members a state has seen."""
    return F.hll_sketch_estimate(members)


def quantile(share: float, quantiles: str | Column = "quantiles") -> Column:
    """A value whose rank is about ``share`` of the values seen; NULL if there are none."""
    q = F.col(quantiles) if isinstance(quantiles, str) else quantiles
    return F.when(F.kll_sketch_get_n_double(q) > 0, F.kll_sketch_get_quantile_double(q, F.lit(share)))
