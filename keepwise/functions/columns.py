"""Column expressions: all native Spark expressions (whole-stage codegen)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepwise import constants as K

# fixed value: text that pandas' numeric parser accepts (decimal / exponent forms)
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
EDGE_SPACE = r"^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_number(x) -> Column:
    """Text or number -> double; unparseable text -> NULL; NaN -> NULL.

    Spark would cast '1d' to 1.0 and ANSI ``cast`` throws on junk, so text is
    guarded by a pattern and cast with ``try_cast``.
    """
    c = _c(x)
    as_text = c.cast("string")
    guarded = F.when(as_text.rlike(NUMERIC_TEXT), F.regexp_replace(as_text, EDGE_SPACE, ""))
    v = guarded.try_cast("double")
    return F.when(~F.isnan(v), v)


def strip_text(x) -> Column:
    """Remove leading/trailing whitespace of every kind (``trim`` drops spaces only)."""
    return F.regexp_replace(_c(x), EDGE_SPACE, "")


def clean_category(x) -> Column:
    s = strip_text(x)
    return F.when(s.isNull() | s.isin(*K.UNKNOWN_MARKERS), F.lit(K.UNKNOWN)).otherwise(s)


def clean_target(x) -> Column:
    """number or missing -> missing = 0 -> truncate toward zero -> clip to {0, 1}."""
    v = F.coalesce(to_number(x), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).cast("int")


def watch_per_profile(hours="watch_hours", profiles="number_of_profiles") -> Column:
    h, p = _c(hours), _c(profiles)
    return F.coalesce(h / F.when(p != 0, p), h)


def engagement_segment(x, q1: float | None, q2: float | None, degenerate: bool) -> Column:
    """Right-closed tertiles; everyone Medium when cut points repeat."""
    c = _c(x)
    if degenerate or q1 is None:
        return F.lit("Medium")
    return (
        F.when(c.isNull(), F.lit("nan"))
        .when(c <= F.lit(q1), F.lit("Low"))
        .when(c <= F.lit(q2), F.lit("Medium"))
        .otherwise(F.lit("High"))
    )


def recency_bucket(x="last_login_days") -> Column:
    c = _c(x)
    lo, mid, hi = K.RECENCY_EDGES
    return (
        F.when((c > lo) & (c <= mid), F.lit("Active"))
        .when((c > mid) & (c <= hi), F.lit("Lapsing"))
        .when(c > hi, F.lit("Dormant"))
        .otherwise(F.lit("nan"))
    )


def age_band(x="age") -> Column:
    c = _c(x)
    e, labels = K.AGE_BAND_EDGES, K.AGE_BAND_LABELS
    expr = None
    for i, lab in enumerate(labels):
        cond = (c > e[i]) & (c <= e[i + 1])
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def status(x="churned") -> Column:
    c = _c(x)
    return F.when(c == 1, F.lit("Churned")).when(c == 0, F.lit("Retained"))


def risk_tier(p="churn_probability") -> Column:
    c = _c(p)
    # a missing probability fails both comparisons and lands in Medium, as in
    # the reference rule
    return (
        F.when(c >= F.lit(K.RISK_HIGH_MIN), F.lit("High"))
        .when(c <= F.lit(K.RISK_LOW_MAX), F.lit("Low"))
        .otherwise(F.lit("Medium"))
    )


def revenue_at_risk(p="churn_probability", fee="monthly_fee", months: int = K.REVENUE_MONTHS) -> Column:
    return _c(p) * _c(fee) * F.lit(float(months))


def recommended_action(tier="risk_tier") -> Column:
    m = F.create_map(*[x for k, v in K.ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(tier)]


def key_factor(m_login: float, m_daily: float, m_fee: float) -> Column:
    return (
        F.when(F.col("last_login_days") >= F.lit(m_login) * F.lit(1.5), F.lit(K.KEY_FACTORS[0]))
        .when(F.col("avg_watch_time_per_day") <= F.lit(m_daily) * F.lit(0.5), F.lit(K.KEY_FACTORS[1]))
        .when(F.col("monthly_fee") >= F.lit(m_fee), F.lit(K.KEY_FACTORS[2]))
        .otherwise(F.lit(K.KEY_FACTORS[3]))
    )


def fmt_money(x) -> Column:
    """'$1,234' with no decimals, half to even, as Python's format does."""
    return F.concat(F.lit("$"), F.format_number(F.bround(_c(x), 0), 0))


def money(x) -> Column:
    """Exact money sum argument: fees have cents, so sum as decimal."""
    return _c(x).cast("decimal(18,2)")
