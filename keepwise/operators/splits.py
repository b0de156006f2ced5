"""Split, folds and preprocessing G1-G6.

Row order inside a class comes from a hash of the key, ``md5(id || ':' || seed)``
(same bits in every engine), ties by key. The split does not sort a class in
one task: the hash prefix is a 52-bit number, the cut per class is found by the
rank selection of ``functions.quantiles``, the last test row among those tied on
it by a top-k on executors, and membership is then a plain filter. Folds need every row's rank, which comes
from parallel running counts over a range-partitioned hash order.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise import constants as K
from keepwise.functions.prefix import running_totals
from keepwise.functions.quantiles import group_stats, select_ranks


def row_hash(key: str, salt: str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)))


def _prefix52(h: Column) -> Column:
    """First 13 hex digits as a number: exact in a double, ordered like the text."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double")


def class_test_sizes(counts: dict[int, int], frac: float) -> dict[int, int]:
    """Test rows per class: train sizes by largest remainder of the class shares
    of n_train = n - ceil(frac * n) (ties by class order), test = the rest."""
    n = sum(counts.values())
    n_test = math.ceil(frac * n)
    n_train = n - n_test
    labels = sorted(counts)
    cont = {c: counts[c] / n * n_train for c in labels}
    floor = {c: math.floor(cont[c]) for c in labels}
    need = n_train - sum(floor.values())
    for c in sorted(labels, key=lambda c: (-(cont[c] - floor[c]), c))[:need]:
        floor[c] += 1
    return {c: counts[c] - floor[c] for c in labels}


def stratified_split(df: DataFrame, label: str = K.TARGET, frac: float = K.TEST_SIZE,
                     seed: int = K.RANDOM_STATE, key: str = K.ID_COL) -> DataFrame:
    """G1: add ``split`` ('train' / 'test') keeping the class ratio exactly.

    Within each class the first ``t_c`` rows by (hash, key) are test rows.
    """
    h = row_hash(key, f":{seed}")
    keyed = df.withColumn("__h", h)
    long = keyed.select(F.col(label).cast("int").alias("cid"), _prefix52(F.col("__h")).alias("v")).persist()
    try:
        stats = group_stats(long)
        sizes = class_test_sizes({c: s.n for c, s in stats.items()}, frac)
        wanted = {c: {t - 1} for c, t in sizes.items() if t > 0}
        found = select_ranks(long, wanted, stats)
    finally:
        long.unpersist()

    cond = F.lit(False)
    for c, t in sizes.items():
        if t <= 0:
            continue
        v, below = found[(c, t - 1)]
        take = t - below                       # rows needed among those tied on the prefix
        tied = keyed.where((F.col(label) == c) & (_prefix52(F.col("__h")) == F.lit(v))) \
            .groupBy("__h", F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        # one row per (hash, key), so repeated rows of a key are one; its last taken row comes from a running count
        counted = running_totals(tied, [F.asc("__h"), F.asc("k")], {"upto": F.col("n")})
        last = counted.where(F.col("upto") >= take).orderBy("upto").first()
        in_class = F.col(label) == c
        p = _prefix52(F.col("__h"))
        cut = (p < F.lit(v)) | (
            (p == F.lit(v)) & ((F.col("__h") < F.lit(last["__h"]))
                               | ((F.col("__h") == F.lit(last["__h"])) & (F.col(key) <= F.lit(last["k"]))))
        )
        cond = cond | (in_class & cut)
    return keyed.withColumn("split", F.when(cond, "test").otherwise("train")).drop("__h")


def with_folds(df: DataFrame, k: int = K.CV_FOLDS, seed: int = K.RANDOM_STATE, label: str = K.TARGET,
               key: str = K.ID_COL) -> DataFrame:
    """``fold`` = (rank within class by (hash, key) - 1) mod k.

    The label is the cleaned 0/1 target (B7), so the two class ranks are two
    running counts over one hash order; other labels are an error.
    """
    h = row_hash(key, f":{seed}:fold")
    keyed = df.withColumn("__h", h)
    labels = [0, 1]
    known = F.coalesce(F.col(label).isin(labels), F.lit(False))
    keyed = keyed.withColumn(label, F.when(known, F.col(label)).otherwise(
        F.raise_error(F.concat(F.lit(f"{label} must be 0 or 1, not "), F.coalesce(F.col(label).cast("string"), F.lit("null"))))
        .cast(keyed.schema[label].dataType)))
    ranked = running_totals(
        keyed, [F.asc("__h"), F.asc(key)],
        {f"__r{c}": (F.col(label) == c).cast("long") for c in labels},
    )
    rank = None
    for c in labels:
        rank = F.when(F.col(label) == c, F.col(f"__r{c}")) if rank is None else rank.when(F.col(label) == c, F.col(f"__r{c}"))
    return ranked.withColumn("fold", ((rank - 1) % k).cast("int")).drop("__h", *[f"__r{c}" for c in labels])


#: shares of a category's cells, so that a hot category meets its slot in many tasks
SALTS = 64


# --- preprocessing ------------------------------------------------------------------

def fit_scaler(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """G3 fit: mean and population std per column (one aggregate)."""
    row = train.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """G3 apply: (x - mean) / std; zero std -> divide by 1."""
    return df.withColumns({
        c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in stats.items()
    })


def one_hot(train: DataFrame, df: DataFrame, cols: list[str], key: str = K.ID_COL) -> DataFrame:
    """The non-zero cells of the one-hot matrix, long form.

    Categories are those seen in training, in alphabetical order (``slot``);
    an unseen or missing value gives an all-zero row, i.e. no cell here.
    """
    def long(d: DataFrame, with_key: bool) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
        return d.select(*([key] if with_key else []), F.inline(pairs))

    seen = long(train, False).distinct()
    seen = seen.withColumn("slot", F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1)
    salted = seen.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    share = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    cells = long(df, True).withColumn("__salt", share).join(salted, ["column", "value", "__salt"])
    return cells.select(
        key, F.concat(F.col("column"), F.lit("_"), F.col("value")).alias("feature"),
        F.col("slot").cast("int").alias("slot"), F.lit(1.0).alias("value"),
    )


def class_counts(df: DataFrame, label: str = K.TARGET) -> dict[int, int]:
    """Rows per class (a few classes)."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def with_class_weight(train: DataFrame, label: str = K.TARGET, counts: dict[int, int] | None = None) -> DataFrame:
    """Balanced weights n / (2 * n_class) per row.

    The class counts are a two-row aggregate folded into a literal map.
    """
    counts = counts or class_counts(train, label)
    n = sum(counts.values())
    k = len(counts)
    m = F.create_map(*[x for c, nc in counts.items() for x in (F.lit(c), F.lit(n / (k * nc)))])
    return train.withColumn("class_weight", m[F.col(label)])
