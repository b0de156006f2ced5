"""Exactness of the scale helpers against brute force, at several layouts."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwise.functions.prefix import running_totals
from keepwise.functions.quantiles import exact_quantiles


def _duck_quantile(vals, p):
    import duckdb
    sql = "SELECT quantile_cont(x, ?::DOUBLE) FROM (SELECT UNNEST(?::DOUBLE[]) AS x)"
    return duckdb.execute(sql, [p, vals]).fetchone()[0]


@pytest.mark.parametrize("layout", [1, 4, 16])
def test_exact_quantiles_many_passes(spark, layout):
    rnd = random.Random(layout)
    hot = [30.0] * 400                                    # a third of the rows on one value
    vals = hot + [rnd.uniform(-50, 500) for _ in range(700)] + [rnd.choice([1.5, 2.5, 7.0]) for _ in range(100)]
    df = spark.createDataFrame([(v, None if i % 97 == 0 else v * 2) for i, v in enumerate(vals)], "a double, b double")
    df = df.repartition(layout)
    probs = [0.0, 1 / 3, 0.5, 2 / 3, 0.9, 1.0]
    # a coarse grid forces several narrowing passes
    got = exact_quantiles(df, {"a": probs, "b": probs}, grid=4)
    bvals = [v * 2 for i, v in enumerate(vals) if i % 97 != 0]
    for p, g in zip(probs, got["a"]):
        assert g == _duck_quantile(vals, p)
    for p, g in zip(probs, got["b"]):
        assert g == _duck_quantile(bvals, p)


def test_exact_quantiles_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert exact_quantiles(df, {"a": [0.5]}) == {"a": [None]}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_running_totals_match_cumsum(spark, parts):
    rnd = random.Random(parts)
    rows = [(i, rnd.random(), rnd.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, s double, v int").repartition(parts)
    out = running_totals(df, [F.desc("s"), F.asc("id")], {"cum": F.col("v").cast("long")}, partitions=parts)
    got = {r["id"]: r["cum"] for r in out.collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    expect = dict(zip([r[0] for r in order], np.cumsum([r[2] for r in order]).tolist()))
    assert got == expect


def test_running_totals_restart(spark):
    rows = [(i, i % 3, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g int, s double")
    out = running_totals(df, [F.asc("s")], {"n": F.lit(1).cast("long")}, restart_by=["g"])
    for r in out.collect():
        assert r["n"] == r["id"] // 3 + 1


def test_approx_median_close_to_exact(spark):
    from keepwise.functions.quantiles import approx_quantiles, medians
    rnd = random.Random(3)
    vals = [rnd.uniform(0, 100) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    exact = medians(df, ["a"])["a"]
    approx = approx_quantiles(df, {"a": [0.5]}, accuracy=10_000)["a"][0]
    known = sorted(vals)
    assert exact == _duck_quantile(vals, 0.5)
    # rank error of the one-pass path stays within 1/accuracy (+ one row)
    r = sum(1 for v in known if v <= approx) / len(known)
    assert abs(r - 0.5) <= 1 / 10_000 + 1 / len(known)


def test_exact_quantiles_extreme_values_terminate(spark):
    inf = float("inf")
    vals = [-inf, -1e308, -1e300, 0.0, 1.0, 2.0, 1e300, 1e308, inf, inf] + [float(i) for i in range(40)]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_quantiles(df, {"a": probs}, grid=4)["a"]
    s = sorted(vals)
    for p, g in zip(probs, got):
        h = (len(s) - 1) * p
        lo, hi = s[int(h)], s[min(len(s) - 1, int(h) + 1)]
        if h == int(h):
            assert g == lo
        else:
            assert min(lo, hi) <= g <= max(lo, hi) or (g != g)   # interpolating through inf may give nan


def test_quantile_passes_do_not_follow_the_values(spark, monkeypatch):
    """A million rows over 600 powers of ten take at most four passes after the first summary."""
    from keepwise.functions import quantiles as Q

    df = spark.range(0, 1_000_000, 1, 8).select(F.pow(F.lit(10.0), F.rand(3) * 600 - 300).alias("a"))
    df = df.persist()
    passes = []
    monkeypatch.setattr(Q, "_summary", lambda v, grid, f=Q._summary: (passes.append(1), f(v, grid))[1])
    got = exact_quantiles(df, {"a": [0.5]})["a"][0]
    vals = np.sort(df.toPandas()["a"].to_numpy())
    df.unpersist()
    assert vals[499_999] <= got <= vals[500_000]
    assert 1 + (len(passes) - 1) / 2 <= 4          # two ranks share a pass


def test_quantiles_of_a_hot_value(spark):
    vals = [1.0] * 5000 + [float(i) for i in range(2, 5000)] + [9e9]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    probs = [0.0, 0.25, 0.5, 0.500001, 0.75, 0.9999, 1.0]
    assert exact_quantiles(df, {"a": probs}, grid=8)["a"] == [_duck_quantile(vals, p) for p in probs]


@pytest.mark.parametrize("desc", [True, False])
def test_running_totals_missing_keys(spark, desc):
    rows = [(i, None if i % 2 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, s double").repartition(5)
    order = [F.desc("s") if desc else F.asc("s"), F.asc("id")]
    got = {r["id"]: r["at"] for r in running_totals(df, order, {"at": F.lit(1).cast("long")}, partitions=7).collect()}
    want = [r["id"] for r in df.orderBy(*order).collect()]
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == want


@pytest.mark.parametrize("partitions", [1024])
def test_running_totals_many_ranges(spark, partitions):
    df = spark.range(5000).select("id", F.rand(1).alias("s"))
    out = running_totals(df, [F.asc("s"), F.asc("id")], {"n": F.lit(1).cast("long")}, partitions=partitions)
    assert out.selectExpr("min(n) = 1 AND max(n) = 5000 AND count(distinct n) = 5000 AS ok").first().ok
    assert "CASE WHEN" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_split_with_a_hot_key(spark):
    """All rows of one key stay together and nothing but the cut reaches the driver."""
    from keepwise.operators.splits import stratified_split, with_folds
    df = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                                  (F.col("id") % 2).cast("int").alias("y"))
    out = stratified_split(df, label="y", key="k")
    assert out.where("k = 'hot'").select("split").distinct().count() == 1
    with pytest.raises(Exception, match="must be 0 or 1"):
        with_folds(spark.createDataFrame([("a", 2)], "k string, y int"), label="y", key="k").collect()
