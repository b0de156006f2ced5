"""Joins by time, sessions, multisets, sketches and event-time streams: odd rows, hot keys, replays."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepwise.operators import joins, multisets, sessions, sketches
from keepwise.streaming import events as streams

START = datetime(2024, 1, 1)


def tuples(df):
    return sorted(repr(tuple(r)) for r in df.collect())  # NaN is written alike, but equals nothing


def some(rng, n, keys, span):
    """Half of all rows have key 0; times repeat."""
    return [(i, rng.choice([0, *rng.choices(range(keys), k=1)]), rng.randrange(span)) for i in range(n)]


@pytest.mark.parametrize("buckets", [1, 3, 40])
@pytest.mark.parametrize("by", [["k"], []])
def test_asof_join(spark, buckets, by):
    rng = random.Random(buckets)
    left = some(rng, 300, 5, 200) + [(900, None, 5), (901, 1, None)]
    right = some(rng, 120, 5, 200) + [(950, None, 5), (951, 1, None)]
    a = spark.createDataFrame([(*r, "x") for r in left], "i int, k int, t int, __t string")
    b = spark.createDataFrame(right, "j int, k int, t int")
    got = joins.asof_join(a, b, "t", "t", by=by, suffix="_r", order=["j"], buckets=buckets)
    assert got.columns == ["i", "k", "t", "__t", "j_r", *(["k_r"] if not by else []), "t_r"]
    for r in got.collect():
        known = [x for x in right if x[2] is not None and (not by or x[1] is not None)]
        met = [x for x in known if r["t"] is not None and x[2] <= r["t"] and (not by or x[1] == r["k"])]
        best = max(met, key=lambda x: (x[2], x[0]), default=(None, None, None))
        assert (r["j_r"], r["t_r"]) == (best[0], best[2])
    assert got.count() == len(left)
    assert joins.asof_join(a.limit(0), b, "t", "t", by=by).count() == 0
    assert joins.asof_join(a, b.limit(0), "t", "t", by=by).where("j_right IS NOT NULL").count() == 0


@pytest.mark.parametrize("width", [None, 1.0, 7.0, 1000.0])
def test_interval_join(spark, width):
    rng = random.Random(3)
    spans = lambda n: [(i, rng.choice([0, 0, 1, 2, None]), s, s + rng.choice([0, 1, 5, 90, -4])) for i in range(n) for s in [rng.randrange(-100, 300)]]
    left, right = spans(120), spans(90) + [(99, 0, None, 4)]
    a, b = spark.createDataFrame(left, "i int, k int, s int, e int"), spark.createDataFrame(right, "j int, k int, s int, e int")
    got = joins.interval_join(a, b, ("s", "e"), ("s", "e"), by=["k"], width=width)
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1] and y[2] is not None
                  and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r["i"], r["j_right"]) for r in got.collect()) == want


@pytest.mark.parametrize("bucket", [10, 3600, 10**7])
def test_sessions_of_a_hot_key(spark, bucket):
    rng = random.Random(bucket)
    rows = [(i, rng.choice(["hot", "hot", "a", "b", None]), START + timedelta(seconds=rng.randrange(20_000)) if i % 30 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp").withColumn("__at", F.lit(1))
    got = {r["id"]: r for r in sessions.with_sessions(df, "k", "ts", 60, order=["id"], bucket_seconds=bucket).collect()}
    want = {}
    for key in ("hot", "a", "b"):
        n, prior = 0, None
        for i, _, ts in sorted((r for r in rows if r[1] == key and r[2]), key=lambda r: (r[2], r[0])):
            gap = (ts - prior).total_seconds() if prior else None
            n += gap is None or gap > 60
            want[i], prior = (n, gap), ts
    assert {i: (r["session"], r["gap"]) for i, r in got.items()} == want
    per = sessions.sessions(df, "k", "ts", 60, order=["id"], bucket_seconds=bucket)
    assert per.agg(F.sum("events")).first()[0] == len(want)


def test_look_back(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "a"]), START + timedelta(seconds=rng.randrange(3000)), float(rng.randrange(500)) / 100) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp, v double")
    for r in sessions.look_back(df, "k", "ts", 100, "v").collect():
        seen = [x for x in rows if x[1] == r["k"] and timedelta(0) <= r["ts"] - x[2] <= timedelta(seconds=100)]
        assert r["recent_events"] == len(seen) and r["recent_total"] == pytest.approx(sum(x[3] for x in seen))


def test_multisets(spark):
    rng = random.Random(1)
    pick = lambda n: [(rng.choice([None, 1, 2]), rng.choice(["a", None, "b"]), float("nan") if rng.random() < 0.2 else 1.0) for _ in range(n)]
    a, b = (spark.createDataFrame(pick(n), "x int, y string, __a double") for n in (200, 120))
    assert tuples(multisets.except_all(a, b)) == tuples(a.exceptAll(b))
    assert tuples(multisets.intersect_all(a, b)) == tuples(a.intersectAll(b))
    assert multisets.symmetric_difference(a, a).count() == 0
    assert multisets.except_all(a.limit(0), b).count() == 0
    with pytest.raises(ValueError):
        multisets.except_all(a, b.drop("y"))


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0), (None, "n", 0.0), (5, "e", float("nan"))], "id int, before string, x double")
    new = spark.createDataFrame([(1, "a", 1.0, 7), (2, "b", 2.0, None), (4, "d", 4.0, None), (None, "m", 0.0, None), (5, "e", float("nan"), None)],
                                "id int, before string, x double, more int")
    got = {r["id"]: (r["change"], r["changed"]) for r in multisets.snapshot_diff(old, new, ["id"]).collect()}
    assert got == {1: ("changed", ["more"]), 2: ("changed", ["x"]), 3: ("removed", []), 4: ("added", []), None: ("changed", ["before"])}
    with pytest.raises(Exception, match="several rows"):
        multisets.snapshot_diff(old.union(old), new, ["id"]).collect()


def test_sketches_within_their_bounds(spark):
    n = 40_000
    df = spark.range(n).select((F.col("id") % 7).alias("g"), (F.col("id") % 9_000).alias("who"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    states = sketches.build(df, ["g"], "who", "v")
    late = sketches.build(df.where("id % 2 = 0"), ["g"], "who", "v")  # states of rows seen before change no set
    for merged in (sketches.merge(states, []), sketches.merge(states.unionByName(late).orderBy(F.desc("g")), [])):
        row = merged.select(sketches.distinct_members().alias("d"), *[sketches.quantile(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99))]).first()
        assert abs(row["d"] / 9_000 - 1) <= sketches.set_error()
        assert all(abs(row[f"q{i}"] / n - q) <= sketches.rank_error() + 0.002 for i, q in enumerate((0.1, 0.5, 0.99)))
    none = sketches.build(df.where("g = 0").select("g", F.lit(None).cast("string").alias("who"), F.lit(None).cast("double").alias("v")), ["g"], "who", "v")
    row = none.select(sketches.distinct_members().alias("d"), sketches.quantile(0.5).alias("q")).first()
    assert (row["d"] or 0, row["q"]) == (0, None)


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    times = [[0, 10, None], [20, 30], [5, 40], [11, 19, 50]]
    batches = [spark.createDataFrame([(i * 10 + j, START + timedelta(hours=h) if h is not None else None) for j, h in enumerate(hours)], "id int, ts timestamp")
               for i, hours in enumerate(times)]
    for i in (0, 1, 1, 2, 2, 3, 3):
        streams.split_late(spark, batches[i], i, path, "ts", timedelta(hours=6))
    late = sorted(r["id"] for r in spark.read.parquet(f"{path}/late").collect())
    on_time = sorted(r["id"] for r in spark.read.parquet(f"{path}/on_time").collect())
    # batch 2 is judged by batch 0 (10 h less 6), batch 3 by batches 0 and 1 (30 h less 6)
    assert late == [30, 31] and on_time == [0, 1, 2, 10, 11, 20, 21, 32]


def test_stored_views_are_read_by_another_session(spark):
    from keepwise.operators import descriptive
    from keepwise.plans import fixtures as fx
    from keepwise.sources import io
    from tests.conftest import SF001

    spark.range(1).createOrReplaceTempView("vw_kpi_summary")  # would hide the stored view
    io.save_fact(fx.clean_table(spark, SF001), "fact_subscriber")
    io.register_views(spark)
    other = spark.newSession()
    for name, build in (("vw_kpi_summary", descriptive.kpi_summary), ("vw_revenue_by_plan", descriptive.revenue_by_plan),
                        ("vw_churn_by_segment", descriptive.churn_by_segment)):
        assert not [t for t in other.catalog.listTables() if t.name == name and t.isTemporary]
        assert other.table(name).collect() == build(spark.table("fact_subscriber")).collect()
