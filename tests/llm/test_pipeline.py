"""The pipeline against its stages done plainly, and the registry."""
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from keepwise.llm import secret_scan, simhash, toxicity
from keepwise.llm.queries import held_out
from tests.conftest import SF001
from tests.llm.conftest import empty
from tests.llm.test_simhash import slow_components, slow_print


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("key", ["op6_warc", "op9_top_k", "op11_spelling_variants", "op12_chat_format"])
def test_oracles(spark, key):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    res = con.execute(__spark_entry__.oracle_sql()[key])
    names = [d[0] for d in res.description]
    df = __spark_entry__.queries()[key](spark, SF001)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, res.fetchall()))


def test_stages_one_by_one(spark, docs001):
    docs, kept = docs001, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF001)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF001}/labels.parquet"), held_out=held_out())
            low = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.7}
            assert {r.doc_id for r in after.collect()} == low <= {r.doc_id for r in docs.collect()}
        elif name == "simhash_near_dedup":
            rows = [(r.doc_id, slow_print(r.text)) for r in docs.collect()]
            assert sorted(r.doc_id for r in after.collect()) == sorted(set(slow_components(rows)))
        elif name == "secret_scan":
            before = {r.doc_id: r.text for r in docs.collect()}
            keys = secret_scan.automaton()
            for r in after.collect():
                if secret_scan.byte_spans(before[r.doc_id].encode(), keys):
                    assert "[SECRET]" in r.text and not secret_scan.byte_spans(r.text.replace("[SECRET]", "").encode(), keys)
                else:
                    assert r.text == before[r.doc_id]
                assert r.n_chars == len(r.text)
        elif name == "mixing":
            kept = {r.doc_id: r.text for r in docs.collect()}
            assert {r.doc_id for r in after.collect()} <= set(kept)
        else:
            total = sum(r.length for r in after.collect())
            assert total == sum(len(r.ids) for r in after.collect())
        if name != "packing":
            assert after.columns == docs001.columns
            path = spark.sparkContext.getCheckpointDir() + f"/test-{name}-{np.random.default_rng().integers(1 << 60)}"
            after.write.parquet(path)
            docs = spark.read.parquet(path)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert out.count() > 0 and {"doc_id", "ids", "length", "sequence_id"} <= set(out.columns)
    assert out.selectExpr("count(distinct sequence_id) = count(*) AS ok").first().ok


def test_odd_and_empty_documents(spark, odd):
    for docs in (odd, empty(odd)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF001)
            assert name == "packing" or after.columns == odd.columns
            rows = after.collect()
            assert rows or not docs.count()
    assert simhash.one_of_each(odd).count() == simhash.near_duplicates(odd).select("root").distinct().count()
