"""Registered queries M1-M6: the operators of SURVEY §2.M over ``events``, ``orders`` and the fixtures.

Orders are moved on by 25 years, into the time of the events.
"""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.operators import joins, multisets, sessions, sketches
from keepwise.plans import fixtures as fx
from keepwise.plans.oracle_ctes import with_ctes
from keepwise.plans.registry import query
from keepwise.sources import io
from keepwise.streaming import events as streams

GAP = 30 * 60 * 24  # half a day in seconds: events of a user are days apart


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '25' YEAR")
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.col("o_custkey").alias("user_id"), moved.alias("o_time"), "o_totalprice")


_ORDERS = "o AS (SELECT o_orderkey, o_custkey AS user_id, o_orderdate + INTERVAL 25 YEAR AS o_time, o_totalprice FROM orders)"


@query("m1_asof_join", f"""WITH {_ORDERS}, last AS (
    SELECT user_id, o_time, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM o GROUP BY user_id, o_time)
SELECT e.event_id, e.user_id, l.o_orderkey AS order_key, l.o_totalprice AS order_price
FROM events e ASOF LEFT JOIN last l ON e.user_id = l.user_id AND e.ts >= l.o_time""")
def m1(spark, sf):
    """The last order of each event's user up to the event."""
    found = joins.asof_join(_events(spark, sf), _orders(spark, sf), "ts", "o_time", by=["user_id"], suffix="_o", order=["o_orderkey"])
    return found.select("event_id", "user_id", F.col("o_orderkey_o").alias("order_key"), F.col("o_totalprice_o").alias("order_price"))


_SESSIONS = f"""e AS (
    SELECT *, lag(ts) OVER w AS prior FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), c AS (
    SELECT *, CAST(sum(CASE WHEN prior IS NULL OR epoch_us(ts) - epoch_us(prior) > {GAP * 1_000_000} THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM e
), s AS (
    SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM c GROUP BY user_id, session
)"""


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sessions(_events(spark, sf), "user_id", "ts", GAP, "value", order=["event_id"])


@query("m2_interval_join", f"""WITH {_ORDERS}, {_SESSIONS}
SELECT s.user_id, s.session, o.o_orderkey AS order_key FROM s JOIN o ON s.user_id = o.user_id
    AND s.started <= o.o_time + INTERVAL 60 DAY AND o.o_time - INTERVAL 60 DAY <= s.ended""")
def m2(spark, sf):
    """Sessions within 60 days of an order of the same user."""
    near = _orders(spark, sf).withColumns({"from": F.expr("o_time - INTERVAL '60' DAY"), "to": F.expr("o_time + INTERVAL '60' DAY")})
    found = joins.interval_join(_sessions(spark, sf), near, ("started", "ended"), ("from", "to"), by=["user_id"], suffix="_o")
    return found.select("user_id", "session", F.col("o_orderkey_o").alias("order_key"))


@query("m3_sketches", with_ctes("sub") + f"""SELECT subscription_type, COUNT(*) AS n, TRUE AS members_close, TRUE AS median_close, TRUE AS order_free
FROM sub GROUP BY subscription_type""")
def m3(spark, sf):
    """States per plan and region, merged per plan, against exact figures (within the bounds of ``sketches``)."""
    sub = fx.sub(spark, sf)
    states = sketches.build(sub, ["subscription_type", "region"], "customer_id", "watch_hours")
    path = io.shared_path(spark, io.tag(sf), "sketches")
    states.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    merged = sketches.merge(stored, ["subscription_type"])
    steps = sketches.merge(sketches.merge(stored.repartition("region"), ["subscription_type", "region"]), ["subscription_type"])
    again = steps.select("subscription_type", sketches.distinct_members().alias("members_again"))
    median, rank = sketches.quantile(0.5), sketches.rank_error()
    exact = sub.join(F.broadcast(merged.select("subscription_type", median.alias("m"))), "subscription_type").groupBy("subscription_type").agg(  # a row per plan
        F.count_distinct("customer_id").alias("d"), F.avg((F.col("watch_hours") < F.col("m")).cast("double")).alias("below"),
        F.avg((F.col("watch_hours") <= F.col("m")).cast("double")).alias("upto"))
    met = merged.select("subscription_type", "n", sketches.distinct_members().alias("members")).join(exact, "subscription_type").join(again, "subscription_type")
    return met.select(
        "subscription_type", "n", (F.abs(F.col("members") / F.col("d") - 1) <= sketches.set_error()).alias("members_close"),
        ((F.col("below") <= 0.5 + rank) & (F.col("upto") >= 0.5 - rank)).alias("median_close"),
        (F.abs(F.col("members") / F.col("members_again") - 1) <= sketches.set_error()).alias("order_free"))


@query("m4_sessions", f"WITH {_SESSIONS} SELECT * FROM s")
def m4(spark, sf):
    out = _sessions(spark, sf)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("m4_look_back", """SELECT event_id, count(*) OVER w AS recent_events, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS recent_total
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""")
def m4_look_back(spark, sf):
    """Of each event its user's events and value of the last seven days."""
    seen = sessions.look_back(_events(spark, sf), "user_id", "ts", 7 * 24 * 3600, "value")
    return seen.select("event_id", "recent_events", "recent_total")


BATCHES, DELAY_HOURS = 5, 6


@query("m5_stream_windows", f"""WITH r AS (
    SELECT *, least(CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1.0) * {BATCHES}) AS INT), {BATCHES - 1}) AS place
    FROM events
), p AS (
    SELECT *, CASE WHEN event_id % 7 = 0 THEN {BATCHES - 1} ELSE place END AS batch FROM r
), m AS (
    SELECT max(ts) FILTER (batch < {BATCHES - 2}) - INTERVAL {DELAY_HOURS} HOUR AS mark, max(ts) - INTERVAL {DELAY_HOURS} HOUR AS last_mark FROM p
), k AS (
    SELECT p.*, batch = {BATCHES - 1} AND epoch_us(ts) <= epoch_us(mark) // 1000 * 1000 AS late, last_mark FROM p CROSS JOIN m
)
SELECT 'window' AS kind, time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM k WHERE NOT late GROUP BY 2, 3, last_mark HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= last_mark
UNION ALL SELECT 'late', time_bucket(INTERVAL 1 DAY, ts), event_type, count(*), CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) FROM k WHERE late GROUP BY 2, 3""")
def m5(spark, sf):
    """Daily windows of the events as a stream of five batches.

    Every third event comes twice; every seventh comes with the last batch
    only, where most are late and go to the side.
    """
    rows = _events(spark, sf)
    ends = rows.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    place = F.least(F.floor((F.unix_micros("ts") - ends["a"]) / F.lit(ends["b"] - ends["a"] + 1.0) * BATCHES), F.lit(BATCHES - 1))
    batch = F.when(F.col("event_id") % 7 == 0, BATCHES - 1).otherwise(place)
    dealt = rows.withColumn("batch", batch).withColumn("times", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    folder = f"{io.shared_path(spark, io.tag(sf), 'stream')}/{spark.sparkContext.applicationId}-{id(rows)}"
    files = 4
    for i in range(BATCHES):  # in the order in which a source would see them
        dealt.where(F.col("batch") == i).drop("batch", "times").repartition(files).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
    closed = streams.start_windows(stream, f"{folder}/windows", f"{folder}/c1", time="ts", delay=f"{DELAY_HOURS} hours", length="1 day",
                                   by=["event_type"], event_id="event_id", value="value")
    aside = streams.start_split(stream, f"{folder}/split", f"{folder}/c2", "ts", timedelta(hours=DELAY_HOURS))
    closed.awaitTermination()
    aside.awaitTermination()
    late = spark.read.schema(rows.schema).parquet(f"{folder}/split/late").dropDuplicates(["event_id"])
    late = late.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    late = late.select(F.lit("late").alias("kind"), F.col("w.start").alias("window_start"), "event_type", "events", "total")
    schema = "window_start timestamp, event_type string, events long, total double"
    shut = spark.read.schema(schema).parquet(f"{folder}/windows").select(F.lit("window").alias("kind"), "*")
    return shut.unionByName(late).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sub = fx.sub(spark, sf).select("subscription_type", "region", "device", "customer_id")
    half = lambda r: sub.where(F.col("customer_id") % 2 == r).select(
        "subscription_type", F.when(F.col("region") != "ASIA", F.col("region")).alias("region"), "device")
    return half(0), half(1)


_PAIRS = [f"h{r} AS (SELECT subscription_type, CASE WHEN region <> 'ASIA' THEN region END AS region, device FROM sub WHERE customer_id % 2 = {r})" for r in (0, 1)]


@query("m6_except_all", with_ctes("sub", extra=_PAIRS) + "SELECT * FROM h0 EXCEPT ALL SELECT * FROM h1")
def m6_except(spark, sf):
    return multisets.except_all(*_pairs(spark, sf))


@query("m6_intersect_all", with_ctes("sub", extra=_PAIRS) + "SELECT * FROM h0 INTERSECT ALL SELECT * FROM h1")
def m6_intersect(spark, sf):
    return multisets.intersect_all(*_pairs(spark, sf))


_NEW = """new AS (
    SELECT customer_id + CASE WHEN customer_id % 11 = 0 THEN 1000000 ELSE 0 END AS customer_id,
        CASE WHEN customer_id % 3 = 0 THEN NULL ELSE device END AS device, CASE WHEN customer_id % 5 = 0 THEN monthly_fee + 1 ELSE monthly_fee END AS monthly_fee
    FROM sub)"""


@query("m6_snapshot_diff", with_ctes("sub", extra=[_NEW]) + """SELECT customer_id, CASE WHEN o.customer_id IS NULL THEN 'added' WHEN n.customer_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN o.customer_id IS NULL OR n.customer_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.device IS DISTINCT FROM n.device THEN 'device' END,
        CASE WHEN o.monthly_fee IS DISTINCT FROM n.monthly_fee THEN 'monthly_fee' END) END AS changed, o.monthly_fee AS fee_before, n.monthly_fee AS fee_after
FROM sub o FULL JOIN new n USING (customer_id)
WHERE o.customer_id IS NULL OR n.customer_id IS NULL OR o.device IS DISTINCT FROM n.device OR o.monthly_fee IS DISTINCT FROM n.monthly_fee""")
def m6_diff(spark, sf):
    old = fx.sub(spark, sf).select("customer_id", "device", "monthly_fee")
    gone = F.col("customer_id") % 11 == 0
    new = old.select(
        (F.col("customer_id") + F.when(gone, 1_000_000).otherwise(0)).alias("customer_id"),
        F.when(F.col("customer_id") % 3 != 0, F.col("device")).alias("device"),
        (F.col("monthly_fee") + F.when(F.col("customer_id") % 5 == 0, 1.0).otherwise(0.0)).alias("monthly_fee"))
    feed = multisets.snapshot_diff(old, new, ["customer_id"])
    return feed.select("customer_id", "change", F.array_join("changed", ",").alias("changed"),
                       F.col("before.monthly_fee").alias("fee_before"), F.col("after.monthly_fee").alias("fee_after"))
