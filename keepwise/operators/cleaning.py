"""Cleaning chain B1-B9: rename -> coerce -> dedupe -> impute -> categories ->
range filter -> target. Medians are taken after dedupe and before the range
filter, so out-of-range values take part in them (as in the reference)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from keepwise import constants as K
from keepwise.functions import columns as C
from keepwise.functions.staging import staged
from keepwise.functions.quantiles import approx_quantiles, medians

SEQ = "ingest_seq"


def normalize_columns(df: DataFrame) -> DataFrame:
    """B1: strip and lowercase every column name."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def coerce_numeric(df: DataFrame, cols: list[str] = K.NUMERIC_COLS) -> DataFrame:
    """B2: numeric columns to double; unparseable text and NaN -> NULL."""
    out = {}
    for c in cols:
        f = df.schema[c]
        if isinstance(f.dataType, NumericType):
            v = F.col(c).cast("double")
            out[c] = F.when(~F.isnan(v), v)
        else:
            out[c] = C.to_number(c)
    return df.withColumns(out)


def dedupe(df: DataFrame, key: str = K.ID_COL, order: str = SEQ, keep_count: bool = False) -> DataFrame:
    """One row per key, the first by ``order`` wins.

    A grouped ``min(struct(order, ...))`` rather than a window: partial
    aggregation collapses a hot key on the map side, so a key holding a third
    of the rows never sorts in one task. ``dropDuplicates`` is not used because
    which row it keeps is undefined.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    first = F.min(F.struct(F.col(order).alias(order), *[F.col(c) for c in rest])).alias("__first")
    aggs = [first] + ([F.count(F.lit(1)).alias("__copies")] if keep_count else [])
    g = df.groupBy(key).agg(*aggs)
    cols = [F.col(key)] + [F.col(f"__first.{c}").alias(c) for c in [order] + rest]
    if keep_count:
        cols.append(F.col("__copies"))
    return g.select(*cols).select(*df.columns, *(["__copies"] if keep_count else []))


def impute_median(df: DataFrame, cols: list[str] = K.NUMERIC_COLS, approx: bool = False, **kw) -> DataFrame:
    """Missing numeric -> exact column median (linear interpolation).

    ``approx=True`` uses one ``percentile_approx`` pass instead (rank error
    1/accuracy) when an exact median is not required.
    """
    if approx:
        med = {c: v[0] for c, v in approx_quantiles(df, {c: [0.5] for c in cols}, **kw).items()}
    else:
        med = medians(df, cols, **kw)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(m)) for c, m in med.items() if m is not None
    })


def normalize_categories(df: DataFrame, cols: list[str] = K.CATEGORICAL_COLS) -> DataFrame:
    """Strip whitespace; missing, '', 'nan', 'None' -> 'Unknown'."""
    return df.withColumns({c: C.clean_category(c) for c in cols})


def range_condition():
    return (
        F.col("age").between(0, 120)
        & (F.col("monthly_fee") >= 0)
        & (F.col("watch_hours") >= 0)
        & (F.col("last_login_days") >= 0)
        & (F.col("number_of_profiles") >= 0)
    )


def range_filter(df: DataFrame) -> DataFrame:
    """Plausible ranges; a missing value fails the check."""
    return df.where(range_condition())


def normalize_target(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """Label to {0, 1}."""
    return df.withColumn(target, C.clean_target(target))


def clean(raw: DataFrame, assume_unique: bool = False) -> DataFrame:
    """The whole chain. Keeps the input column set minus the ingest order.

    ``assume_unique`` skips the dedupe shuffle for sources whose key is
    already a primary key (a typed table read from the warehouse).
    """
    df = coerce_numeric(normalize_columns(raw))
    if assume_unique:
        df = df.drop(SEQ) if SEQ in df.columns else df
    else:
        if SEQ not in df.columns:
            df = df.withColumn(SEQ, F.monotonically_increasing_id())
        # the median passes read the deduplicated table several times: written
        # once, the dedupe shuffle is not repeated and no cache is left behind
        df = staged(dedupe(df).drop(SEQ), "deduplicated")
    return (
        df.transform(impute_median)
        .transform(normalize_categories)
        .transform(range_filter)
        .transform(normalize_target)
    )


def quality_report(raw: DataFrame) -> DataFrame:
    """Rows read, duplicates dropped, range failures, rows kept, churn rate.

    One aggregate over the deduplicated table (which carries its copy counts)
    plus the median job that the imputation needs anyway.
    """
    df = coerce_numeric(normalize_columns(raw))
    dd = staged(dedupe(df, keep_count=True), "deduplicated")   # read by every median pass and the final aggregate
    med = medians(dd, K.NUMERIC_COLS)
    filled = dd.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in med.items() if m is not None})
    ok = range_condition()
    return filled.agg(
        F.sum("__copies").cast("bigint").alias("rows_read"),
        (F.sum("__copies") - F.count(F.lit(1))).cast("bigint").alias("duplicates_dropped"),
        F.count_if(~F.coalesce(ok, F.lit(False))).cast("bigint").alias("range_dropped"),
        F.count_if(F.coalesce(ok, F.lit(False))).cast("bigint").alias("rows_kept"),
        F.avg(F.when(F.coalesce(ok, F.lit(False)), C.clean_target(K.TARGET))).alias("churn_rate"),
    )
