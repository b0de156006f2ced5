"""The splittable CSV reader against one task that reads a file whole."""
import csv
import random

import pytest

from keepwise.sources import io


def random_file(path, seed, end="\n", rows=300):
    rng = random.Random(seed)
    bits = ["a", "é", ",", "\n", '"', " ", "xyz", "\n\n", '""', "12"]
    data = [["k", "t", "u"]]
    for i in range(rows):
        n = rng.choice([0, 1, 3, 3, 60 if i % 40 == 0 else 2])
        data.append([str(i), "".join(rng.choice(bits) for _ in range(n)) or "v", rng.choice(["w", "two\nlines", "NA", 'q"q'])])
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(data)
    return [tuple(None if x == "NA" else x for x in r) for r in data[1:]]


@pytest.mark.parametrize("splits", [1, 4, 16])
@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_one_task(spark, tmp_path, seed, splits):
    path = tmp_path / "in"
    path.mkdir()
    want = random_file(path / "a.csv", seed) + random_file(path / "b.csv", seed + 50, end="\r\n")
    size = (path / "a.csv").stat().st_size
    settings = {"spark.sql.files.maxPartitionBytes": str(size // splits + 1), "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = io.read_raw_csv(spark, str(path), multi_line=True)
        assert got.columns == ["ingest_seq", "k", "t", "u"]
        rows = got.orderBy("ingest_seq").collect()
        assert len({(r["ingest_seq"]["file"], r["ingest_seq"]["block"]) for r in rows}) >= splits
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [tuple(r)[1:] for r in rows] == want
    single = spark.read.options(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False,
                                ignoreTrailingWhiteSpace=False).csv(str(path / "a.csv"))
    assert sorted((r["k"], r["t"]) for r in single.collect()) == sorted((k, t) for k, t, _ in want[:300])


def test_a_record_over_many_splits(spark, tmp_path):
    path = tmp_path / "a.csv"
    long = "\n".join(f'line {i} ""q""' for i in range(2000))
    path.write_text(f'k,t\n1,"{long}"\n2,plain\n\n3,"end\n"\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = io.read_raw_csv(spark, str(path), ["k", "t"], multi_line=True).orderBy("ingest_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["k"], r["t"]) for r in rows] == [("1", long.replace('""', '"')), ("2", "plain"), ("3", "end\n")]


def test_errors(spark, tmp_path):
    (tmp_path / "few.csv").write_text('k,t\n1\n')
    (tmp_path / "head.csv").write_text('k,other\n1,2\n')
    for name in ("few", "head"):
        with pytest.raises(Exception):
            io.read_raw_csv(spark, str(tmp_path / f"{name}.csv"), ["k", "t"], multi_line=True).collect()
    (tmp_path / "none.csv").write_text('k,t\n')
    assert io.read_raw_csv(spark, str(tmp_path / "none.csv"), ["k", "t"], multi_line=True).count() == 0
