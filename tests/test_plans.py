"""Plan properties: no Python in the relational hot path, pruning reaches the scan,
answers independent of the input layout."""
import re

from pyspark.sql import functions as F

from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_in_relational_queries(spark):
    from keepwise.plans.registry import oracles, queries
    qs = queries()
    for key in set(oracles()) - {"a1_quoted_csv"}:  # which puts the lines of quoted records together
        plan = _plan(qs[key](spark, SF001))
        assert not re.search("PythonUDF|BatchEvalPython|ArrowEvalPython|MapInArrow|MapInPandas|FlatMapGroups|PythonRDD", plan), key


def test_snapshot_scan_reads_only_needed_columns(spark):
    from keepwise.plans import fixtures as fx
    plan = _plan(fx.snap(spark, SF001))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan


def test_filter_pushed_to_parquet(spark):
    from keepwise.operators.filters import filter_subscribers
    path = f"{SF001}/customer.parquet"
    df = spark.read.parquet(path).withColumnRenamed("c_mktsegment", "region").withColumn("age", F.lit(30))
    plan = _plan(filter_subscribers(df, {"region": ["BUILDING", "MACHINERY"]}))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "c_mktsegment" in pushed and "BUILDING" in pushed


def test_layout_independence(spark):
    from keepwise.operators import descriptive as D, metrics as M
    from keepwise.plans import fixtures as fx
    sub = fx.sub(spark, SF001)
    scored = fx.scored_fx(spark, SF001)
    ref_p = sorted(map(tuple, D.priority_all(sub).collect()))
    ref_m = M.score_metrics(scored).first()
    for n in (1, 4, 16):
        assert sorted(map(tuple, D.priority_all(sub.repartition(n)).collect())) == ref_p
        assert M.score_metrics(scored.repartition(n)).first() == ref_m


def test_split_and_folds_layout_independent(spark):
    from keepwise.operators.splits import stratified_split, with_folds
    from keepwise.plans import fixtures as fx
    sub = fx.sub(spark, SF001).select("customer_id", "churned")
    ref = sorted(map(tuple, with_folds(stratified_split(sub)).collect()))
    for n in (1, 4, 16):
        got = sorted(map(tuple, with_folds(stratified_split(sub.repartition(n))).collect()))
        assert got == ref


def test_one_pass_operators_scan_once(spark):
    import tempfile

    from keepwise.operators import campaign as CP, descriptive as D, filters
    from keepwise.plans import fixtures as fx

    d = tempfile.mkdtemp(prefix="kw-onepass-")
    fx.sub(spark, SF001).write.parquet(f"{d}/sub")
    fx.scored_fx(spark, SF001).write.parquet(f"{d}/scored")
    sub = spark.read.parquet(f"{d}/sub")
    scored = spark.read.parquet(f"{d}/scored")
    spec = {"region": ["ASIA"], "age": (20, 60)}
    one_pass = [
        D.kpi_summary(sub), D.executive_kpis(sub), D.key_signals(sub), D.status_profile(sub),
        D.priority_all(sub), D.revenue_tree(sub), D.churn_cube(sub), D.category_share(sub, ["gender", "device"]),
        D.missing_report(sub), filters.filtered_kpis(sub, spec), CP.risk_kpis(scored), CP.campaign_grid(scored),
    ]
    for df in one_pass:
        assert len(re.findall(r"FileScan parquet", _plan(df))) == 1, df.columns


def test_scored_sink_prunes_tier_partitions(spark):
    import tempfile

    from keepwise.operators.scoring import SCORED_COLUMNS
    from keepwise.plans import fixtures as fx
    from keepwise.sources import io

    path = tempfile.mkdtemp(prefix="kw-scored-") + "/scored"
    io.write_scored(fx.scored_fx(spark, SF001), path)
    df = io.read_scored(spark, path, SCORED_COLUMNS).where("risk_tier = 'High'")
    plan = _plan(df)
    assert re.search(r"PartitionFilters: \[[^\]]*risk_tier", plan)
    assert df.count() == fx.scored_fx(spark, SF001).where("risk_tier = 'High'").count()
