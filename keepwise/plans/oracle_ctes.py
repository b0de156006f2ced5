"""DuckDB text of the fixture tables, used to build independent oracles.

Each oracle query is ``with_ctes(names) + body``; the driver tables are
pre-registered views on the DuckDB side.
"""
from __future__ import annotations

SNAP = """
hist AS (
  SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01 00:00:00'
), lines AS (
  SELECT h.o_custkey AS k, l.l_quantity, p.p_type
  FROM hist h JOIN lineitem l ON l.l_orderkey = h.o_orderkey
              JOIN part p ON p.p_partkey = l.l_partkey
), act AS (
  SELECT o_custkey AS k, MAX(o_orderdate) AS last_d, MIN(o_orderdate) AS first_d
  FROM hist GROUP BY o_custkey
), watch AS (
  SELECT k, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS watch_hours
  FROM lines GROUP BY k
), pay AS (
  SELECT k, v FROM (
    SELECT o_custkey AS k, o_orderpriority AS v,
           ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY COUNT(*) DESC, o_orderpriority) AS rn
    FROM hist GROUP BY o_custkey, o_orderpriority) t WHERE rn = 1
), genre AS (
  SELECT k, v FROM (
    SELECT k, p_type AS v, ROW_NUMBER() OVER (PARTITION BY k ORDER BY COUNT(*) DESC, p_type) AS rn
    FROM lines GROUP BY k, p_type) t WHERE rn = 1
), future AS (
  SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00'
), snap AS (
SELECT CAST(c.c_custkey AS BIGINT)                          AS customer_id,
       CAST(18 + (c.c_custkey * 37) % 63 AS DOUBLE)         AS age,
       CASE c.c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Other' END AS gender,
       CASE WHEN c.c_acctbal < 2000 THEN 'Basic' WHEN c.c_acctbal < 6000 THEN 'Standard' ELSE 'Premium' END AS subscription_type,
       w.watch_hours                                        AS watch_hours,
       CAST(date_diff('day', CAST(a.last_d AS DATE), DATE '2001-01-01') AS DOUBLE) AS last_login_days,
       CASE WHEN r.r_name <> 'AMERICA' THEN r.r_name
            WHEN n.n_name IN ('NATION_1', 'NATION_6') THEN 'SOUTH AMERICA' ELSE 'NORTH AMERICA' END AS region,
       c.c_mktsegment                                       AS device,
       CAST(CASE WHEN c.c_acctbal < 2000 THEN 8.99 WHEN c.c_acctbal < 6000 THEN 13.99 ELSE 17.99 END AS DOUBLE) AS monthly_fee,
       CAST(CASE WHEN f.k IS NULL THEN 1 ELSE 0 END AS INT) AS churned,
       pay.v                                                AS payment_method,
       CAST(c.c_custkey % 6 AS DOUBLE)                      AS number_of_profiles,
       w.watch_hours / CAST(GREATEST(date_diff('day', CAST(a.first_d AS DATE), DATE '2001-01-01'), 1) AS DOUBLE) AS avg_watch_time_per_day,
       genre.v                                              AS favorite_genre
FROM customer c
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN act a   ON a.k = c.c_custkey
LEFT JOIN watch w ON w.k = c.c_custkey
LEFT JOIN pay     ON pay.k = c.c_custkey
LEFT JOIN genre   ON genre.k = c.c_custkey
LEFT JOIN future f ON f.k = c.c_custkey
)"""

RAW = """
raw AS (
SELECT CAST(customer_id AS BIGINT) * 2 + d.dup AS ingest_seq,
       CAST(customer_id AS VARCHAR) AS customer_id,
       CASE WHEN customer_id % 40 = 1 THEN 'abc' WHEN customer_id % 40 = 2 THEN ''
            WHEN customer_id % 97 = 3 THEN '-5' WHEN customer_id % 97 = 4 THEN '150'
            ELSE CAST(CAST(age AS INT) AS VARCHAR) END AS age,
       CASE WHEN customer_id % 60 = 5 THEN '   ' WHEN customer_id % 60 = 6 THEN 'nan'
            WHEN customer_id % 60 = 7 THEN 'None' WHEN customer_id % 60 = 8 THEN NULL
            ELSE ' ' || gender || ' ' END AS gender,
       subscription_type,
       CAST(CAST(TRUNC(watch_hours) AS INT) AS VARCHAR) AS watch_hours,
       CAST(CAST(TRUNC(last_login_days) AS INT) AS VARCHAR) AS last_login_days,
       region, device,
       CASE WHEN customer_id % 83 = 8 THEN '-1' WHEN d.dup = 1 THEN '99.99'
            WHEN subscription_type = 'Basic' THEN '8.99' WHEN subscription_type = 'Standard' THEN '13.99' ELSE '17.99' END AS monthly_fee,
       CASE WHEN customer_id % 71 = 9 THEN 'yes' WHEN customer_id % 71 = 10 THEN '2'
            WHEN customer_id % 71 = 11 THEN '-1' ELSE CAST(churned AS VARCHAR) END AS churned,
       payment_method,
       CAST(CAST(number_of_profiles AS INT) AS VARCHAR) AS number_of_profiles,
       CAST(CAST(ROUND(avg_watch_time_per_day * 1000, 0) AS INT) AS VARCHAR) AS avg_watch_time_per_day,
       favorite_genre
FROM snap CROSS JOIN (SELECT 0 AS dup UNION ALL SELECT 1 AS dup) d
WHERE d.dup = 0 OR customer_id % 50 = 0
)"""

SUB = """
sub_med AS (
  SELECT quantile_cont(watch_hours, 0.5::DOUBLE) AS m_hours,
         quantile_cont(last_login_days, 0.5::DOUBLE) AS m_login,
         quantile_cont(avg_watch_time_per_day, 0.5::DOUBLE) AS m_daily FROM snap
), filled AS (
  SELECT s.customer_id, s.age, s.gender, s.subscription_type,
         COALESCE(s.watch_hours, med.m_hours) AS watch_hours,
         COALESCE(s.last_login_days, med.m_login) AS last_login_days,
         s.region, s.device, s.monthly_fee, s.churned,
         COALESCE(s.payment_method, 'Unknown') AS payment_method,
         s.number_of_profiles,
         COALESCE(s.avg_watch_time_per_day, med.m_daily) AS avg_watch_time_per_day,
         COALESCE(s.favorite_genre, 'Unknown') AS favorite_genre
  FROM snap s CROSS JOIN sub_med med
), cuts AS (
  SELECT quantile_cont(avg_watch_time_per_day, 1.0::DOUBLE/3) AS q1,
         quantile_cont(avg_watch_time_per_day, 2.0::DOUBLE/3) AS q2 FROM filled
), sub AS (
SELECT f.*,
       COALESCE(f.watch_hours / NULLIF(f.number_of_profiles, 0), f.watch_hours) AS watch_per_profile,
       CASE WHEN f.avg_watch_time_per_day IS NULL THEN 'nan'
            WHEN f.avg_watch_time_per_day <= c.q1 THEN 'Low'
            WHEN f.avg_watch_time_per_day <= c.q2 THEN 'Medium' ELSE 'High' END AS engagement_segment,
       CASE WHEN f.last_login_days > -1 AND f.last_login_days <= 7 THEN 'Active'
            WHEN f.last_login_days > 7 AND f.last_login_days <= 30 THEN 'Lapsing'
            WHEN f.last_login_days > 30 THEN 'Dormant' ELSE 'nan' END AS recency_bucket,
       CASE WHEN f.churned = 1 THEN 'Churned' ELSE 'Retained' END AS status
FROM filled f CROSS JOIN cuts c
)"""

SCORED = """
sc_p AS (
  SELECT sub.*, last_login_days / (last_login_days + CAST(120 AS DOUBLE)) AS churn_probability FROM sub
), sc_t AS (
  SELECT p.*, CASE WHEN churn_probability >= CAST(0.70 AS DOUBLE) THEN 'High'
                   WHEN churn_probability <= CAST(0.40 AS DOUBLE) THEN 'Low' ELSE 'Medium' END AS risk_tier
  FROM sc_p p
), sc_med AS (
  SELECT quantile_cont(last_login_days, 0.5::DOUBLE) AS m_login,
         quantile_cont(avg_watch_time_per_day, 0.5::DOUBLE) AS m_daily,
         quantile_cont(monthly_fee, 0.5::DOUBLE) AS m_fee FROM sub
), scored AS (
SELECT t.customer_id, t.churn_probability, t.risk_tier, t.monthly_fee,
       t.churn_probability * t.monthly_fee * CAST(12 AS DOUBLE) AS revenue_at_risk,
       CASE t.risk_tier WHEN 'High' THEN 'Offer targeted discount / personalized content'
                        WHEN 'Medium' THEN 'Send re-engagement campaign'
                        ELSE 'Maintain engagement / loyalty rewards' END AS recommended_action,
       CASE WHEN t.last_login_days >= m.m_login * CAST(1.5 AS DOUBLE) THEN 'Low recent activity'
            WHEN t.avg_watch_time_per_day <= m.m_daily * CAST(0.5 AS DOUBLE) THEN 'Low engagement'
            WHEN t.monthly_fee >= m.m_fee THEN 'Higher plan cost'
            ELSE 'Stable usage' END AS key_factor,
       t.subscription_type, t.engagement_segment, t.region, t.age, t.churned
FROM sc_t t CROSS JOIN sc_med m
)"""

PLANTED = """
planted AS (
SELECT s.*, CASE WHEN substr(md5(concat(CAST(customer_id AS VARCHAR), ':flip')), 1, 1) = '0'
                 THEN 1 - base ELSE base END AS label
FROM (SELECT sub.*, CASE WHEN avg_watch_time_per_day < CAST(0.40 AS DOUBLE) OR last_login_days > 250
                         THEN 1 ELSE 0 END AS base FROM sub) s
)"""

COUNTRIES = """
countries AS (
SELECT n_name AS country, r_name AS continent,
       CASE WHEN r_name <> 'AMERICA' THEN r_name
            WHEN n_name IN ('NATION_1', 'NATION_6') THEN 'SOUTH AMERICA' ELSE 'NORTH AMERICA' END AS region
FROM nation JOIN region ON r_regionkey = n_regionkey
)"""

_DEPS = {
    "snap": [],
    "raw": ["snap"],
    "sub": ["snap"],
    "scored": ["sub"],
    "planted": ["sub"],
    "countries": [],
}
_TEXT = {"snap": SNAP, "raw": RAW, "sub": SUB, "scored": SCORED, "planted": PLANTED, "countries": COUNTRIES}


def with_ctes(*names: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause holding the named fixtures (and their inputs) plus extra CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [_TEXT[n].strip() for n in order] + [e.strip() for e in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"
