"""Literal edge cases (FIXTURES §9) for the boundary rules."""
import math

import pytest
from pyspark.sql import functions as F

from keepwise.functions import columns as C
from keepwise.operators import features, metrics as M, models as H


def col_of(spark, values, expr, typ="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_age_bands(spark):
    got = col_of(spark, [0.0, 25.0, 26.0, 35.0, 36.0, 55.0, 56.0, 200.0], C.age_band)
    assert got == [None, "<25", "25-34", "25-34", "35-44", "45-54", "55+", "55+"]


def test_recency(spark):
    got = col_of(spark, [-1.0, 0.0, 7.0, 7.5, 30.0, 31.0, None], C.recency_bucket)
    assert got == ["nan", "Active", "Active", "Lapsing", "Lapsing", "Dormant", "nan"]


def test_tiers(spark):
    got = col_of(spark, [0.40, 0.4000001, 0.6999999, 0.70, None], C.risk_tier)
    assert got == ["Low", "Medium", "Medium", "High", "Medium"]


def test_watch_per_profile(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, None), (12.0, 3.0)], "watch_hours double, number_of_profiles double")
    got = [r[0] for r in df.select(C.watch_per_profile()).collect()]
    assert got == [10.0, 10.0, 4.0]


def test_coercion(spark):
    got = col_of(spark, ["12.5x", " 12 ", "nan", "inf", "1e3", "1d", "0x1A", ""], C.to_number, "string")
    assert got == [None, 12.0, None, None, 1000.0, None, None, None]


def test_target(spark):
    got = col_of(spark, ["yes", "2", "-1", "1.9", None, "0.7"], C.clean_target, "string")
    assert got == [0, 1, 0, 1, 0, 0]


def test_category_cleaning(spark):
    got = col_of(spark, ["  Male\t", "   ", "nan", "None", None, "female"], C.clean_category, "string")
    assert got == ["Male", "Unknown", "Unknown", "Unknown", "Unknown", "female"]


def test_money_format(spark):
    got = col_of(spark, [1234.5, 1235.5, 0.4, 1234567.0], C.fmt_money)
    assert got == ["$1,234", "$1,236", "$0", "$1,234,567"]


def test_repeated_tertile_cuts_make_everyone_medium(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,), (2.0,)], "avg_watch_time_per_day double")
    cuts = features.fit_tertiles(df)
    assert cuts.degenerate
    assert {r[0] for r in features.with_engagement(df, cuts).select("engagement_segment").collect()} == {"Medium"}


def test_tertiles_right_closed_and_missing(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 10)] + [(None,)], "avg_watch_time_per_day double")
    cuts = features.fit_tertiles(df)
    out = dict(features.with_engagement(df, cuts).select("avg_watch_time_per_day", "engagement_segment").collect())
    assert cuts.q1 == pytest.approx(1 + 8 / 3) and out[3.0] == "Low" and out[4.0] == "Medium"
    assert out[None] == "nan" and out[9.0] == "High"


TIED = [(0.9, 1), (0.8, 0), (0.8, 1), (0.6, 1), (0.4, 0), (0.4, 1), (0.2, 0)]


def test_tied_scores_metrics(spark):
    df = spark.createDataFrame(TIED, "churn_probability double, churned int")
    m = M.score_metrics(df).first()
    assert m["pr_auc"] == pytest.approx(0.770833, abs=1e-6)
    assert m["roc_auc"] == pytest.approx(0.75)
    # p >= 0.5: tp = 3, fp = 1, fn = 1, tn = 2
    assert m["precision"] == pytest.approx(0.75) and m["recall"] == pytest.approx(0.75)
    assert m["accuracy"] == pytest.approx(5 / 7)
    assert m["brier"] == pytest.approx(sum((p - y) ** 2 for p, y in TIED) / 7)


def test_tied_scores_isotonic(spark):
    df = spark.createDataFrame([(p, float(y)) for p, y in TIED], "p double, label double")
    iso = H.fit_isotonic(df, "p", "label")
    got = [r["iso"] for r in iso.transform(df.select("p").distinct(), "p", "iso").orderBy(F.desc("p")).collect()]
    assert got == pytest.approx([1.0, 2 / 3, 2 / 3, 0.5, 0.0])


def test_one_class_no_predicted_positives(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.3, 0)], "churn_probability double, churned int")
    m = M.score_metrics(df).first()
    assert m["f1"] == 0.0 and m["precision"] == 0.0 and m["recall"] == 0.0
    assert m["accuracy"] == 1.0 and m["pr_auc"] == 0.0 and m["roc_auc"] is None
    assert not math.isnan(m["brier"])


def test_csv_without_order_column_keeps_first_copy_in_file_order(spark):
    import tempfile

    from keepwise.operators.cleaning import dedupe
    from keepwise.sources.io import read_raw_csv

    d = tempfile.mkdtemp(prefix="kw-csv-")
    with open(f"{d}/raw.csv", "w") as f:
        f.write("customer_id,monthly_fee\n" + "".join(f"{i % 97},{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_raw_csv(spark, f"{d}/raw.csv")
        assert df.rdd.getNumPartitions() > 1
        first = {r["customer_id"]: r["monthly_fee"] for r in dedupe(df).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == {str(k): str(k) for k in range(97)}


def test_missing_csv_is_an_error(spark):
    from pyspark.errors import AnalysisException

    from keepwise.sources.io import read_raw_csv
    with pytest.raises(AnalysisException):
        read_raw_csv(spark, "/nonexistent/keepwise/raw.csv")


def test_absent_metrics_report_reads_empty(spark):
    from keepwise.sources.io import read_metrics
    assert read_metrics(spark, "/nonexistent/keepwise/metrics_json").count() == 0


def test_clean_table_csv_round_trip(spark):
    import tempfile

    from keepwise.plans import fixtures as fx
    from keepwise.sources import io
    clean = fx.clean_table(spark, "/root/testdata/sf0.001")
    path = tempfile.mkdtemp(prefix="kw-clean-csv-") + "/clean"
    io.write_clean(clean, path, fmt="csv")
    back = io.read_clean(spark, path, fmt="csv", schema=clean.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, clean.collect()))


def test_scoring_without_model_is_an_error(spark):
    from keepwise.operators.models import score
    with pytest.raises(FileNotFoundError):
        score(spark.range(1), None)


def test_empty_inputs_give_missing_not_errors(spark):
    from keepwise.operators import descriptive as D
    empty = spark.createDataFrame([], "churn_probability double, churned int")
    row = M.threshold_metrics(empty).first()
    assert row["accuracy"] is None and row["f1"] == 0.0
    assert M.score_metrics(empty).count() == 1
    zero_fee = spark.createDataFrame([(0.0, 1), (0.0, 0)], "monthly_fee double, churned int")
    assert D.executive_kpis(zero_fee).first()["lost_share_pct"] is None


def test_region_map_uses_the_split_region(spark):
    from keepwise.operators import descriptive as D
    countries = D.country_region(spark.createDataFrame(
        [("Brazil", "Americas"), ("Canada", "Americas"), ("France", "Europe"), ("Japan", "Asia")], "country string, continent string"))
    metric = spark.createDataFrame([("South America", 1.0), ("North America", 2.0), ("Europe", 3.0)], "region string, value double")
    got = {r["country"]: r["value"] for r in D.region_to_country(metric, countries).collect()}
    assert got == {"Brazil": 1.0, "Canada": 2.0, "France": 3.0}


def test_share_is_of_the_kept_values(spark):
    from keepwise.operators import descriptive as D
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("zz",)], "x string")
    got = {r["value"]: r["share"] for r in D.category_share(df, "x", ["a", "b", "c"]).collect()}
    assert got == {"a": 2 / 3, "b": 1 / 3}


def test_campaign_answers_for_an_empty_tier(spark):
    from keepwise.operators import campaign as CP
    df = spark.createDataFrame([(1, "High", 0.9, 90.0, 10.0), (2, "Low", 0.1, 10.0, 10.0)],
                               "customer_id long, risk_tier string, churn_probability double, revenue_at_risk double, monthly_fee double")
    grid = CP.campaign_grid(df)
    assert grid.count() == 3 * 21 * 11
    row = CP.campaign(df, "Medium", 0.3, 0.2).first()
    assert row["net_benefit"] == 0.0 and row["customers_saved"] == 0.0 and row["base_churn_rate"] == 0.5
    assert CP.break_even(grid).where("risk_tier = 'Medium' AND break_even_save_rate = 0").count() == 11
    assert {r["risk_tier"]: r["customers"] for r in CP.playbook(df).collect()} == {"Low": 1, "Medium": 0, "High": 1}
    assert CP.campaign(df.where("false"), "High").first()["new_churn_rate"] is None


def test_customer_table_puts_missing_revenue_last(spark):
    from pyspark.sql import functions as F

    from keepwise.functions.prefix import running_totals
    df = spark.createDataFrame([(i, None if i % 2 else float(i)) for i in range(200)], "id int, v double")
    full = running_totals(df, [F.desc("v"), F.asc("id")], {"position": F.lit(1).cast("long")}, partitions=6)
    assert full.where("v IS NULL").agg(F.min("position")).first()[0] == 101


def test_missing_scores_are_left_out(spark):
    from keepwise.operators import metrics as M
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (None, 1)], "churn_probability double, churned int")
    a, b = M.threshold_metrics(df).first(), M.score_metrics(df).first()
    assert a["f1"] == b["f1"] == 1.0 and b["brier"] == M.brier(df).first()["brier"]


def test_average_fee_ignores_missing(spark):
    from keepwise.operators import descriptive as D
    df = spark.createDataFrame([(10.0, 0), (None, 1), (20.0, 1)], "monthly_fee double, churned int")
    assert D.kpi_summary(df).first()["avg_monthly_fee"] == 15.0
    assert D.executive_kpis(df).first()["avg_fee"] == 15.0


def test_csv_dialect(spark, tmp_path):
    from keepwise.sources.io import read_raw_csv
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.csv").write_text('customer_id,genre,age\n1,"Sci-Fi ""Classic"", old",30\n2,x,\n')
    rows = read_raw_csv(spark, str(good)).orderBy("customer_id").collect()
    assert [(r["genre"], r["age"]) for r in rows] == [('Sci-Fi "Classic", old', "30"), ("x", None)]
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.csv").write_text('customer_id,genre,age\n1,"two\nlines",30\n')
    assert read_raw_csv(spark, str(lines), multi_line=True).first()["genre"] == "two\nlines"
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.csv").write_text("customer_id,genre,age\n1,x,30,extra\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_raw_csv(spark, str(bad)).select("customer_id").collect()
    with pytest.raises(Exception, match="(?i)header"):
        read_raw_csv(spark, str(good), ["customer_id", "other", "age"]).collect()
