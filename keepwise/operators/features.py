"""Derived features C1-C7 (scalar column expressions + one quantile fit)."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions import columns as C
from keepwise.functions.quantiles import exact_quantiles


@dataclass(frozen=True)
class Tertiles:
    q1: float | None
    q2: float | None
    degenerate: bool          # repeated cut points: everyone is Medium


def with_watch_per_profile(df: DataFrame) -> DataFrame:
    """Hours per profile; zero or missing profiles -> hours."""
    return df.withColumn("watch_per_profile", C.watch_per_profile())


def fit_tertiles(df: DataFrame, col: str = "avg_watch_time_per_day") -> Tertiles:
    """C2 fit: cut points at 0, 1/3, 2/3, 1 (exact, interpolated)."""
    edges = exact_quantiles(df, {col: [0.0, 1.0 / 3, 2.0 / 3, 1.0]})[col]
    if edges[0] is None:
        return Tertiles(None, None, True)
    return Tertiles(edges[1], edges[2], len(set(edges)) < len(edges))


def with_engagement(df: DataFrame, cuts: Tertiles, col: str = "avg_watch_time_per_day") -> DataFrame:
    """C2 apply: right-closed Low / Medium / High; missing -> 'nan'."""
    return df.withColumn("engagement_segment", C.engagement_segment(col, cuts.q1, cuts.q2, cuts.degenerate))


def with_recency(df: DataFrame) -> DataFrame:
    """(-1,7] Active, (7,30] Lapsing, (30,inf) Dormant, else 'nan'."""
    return df.withColumn("recency_bucket", C.recency_bucket())


def with_age_band(df: DataFrame) -> DataFrame:
    """C4: right-closed age bins; outside the bins -> NULL."""
    return df.withColumn("age_band", C.age_band())


def with_status(df: DataFrame) -> DataFrame:
    """0 -> Retained, 1 -> Churned."""
    return df.withColumn("status", C.status())


def feature_columns(drop: list[str] | tuple = ()) -> tuple[list[str], list[str]]:
    num = [c for c in K.NUMERIC_FEATURES if c not in drop]
    cat = [c for c in K.CATEGORICAL_FEATURES if c not in drop]
    return num, cat


def project_features(df: DataFrame, drop: list[str] | tuple = (), keep_id: bool = True) -> DataFrame:
    """The model features and the label (column pruning reaches the scan)."""
    num, cat = feature_columns(drop)
    return df.select(*([K.ID_COL] if keep_id else []), *num, *cat, K.TARGET)


def add_engineered(df: DataFrame, cuts: Tertiles | None = None) -> DataFrame:
    """C1 + C2 + C3 (+ C5): the feature set shared by models and dashboards.

    Tertiles are fitted on ``df`` itself unless ``cuts`` are given (for
    example fitted on training rows only).
    """
    cuts = cuts or fit_tertiles(df)
    return (
        df.transform(with_watch_per_profile)
        .transform(lambda d: with_engagement(d, cuts))
        .transform(with_recency)
        .transform(with_status)
    )
