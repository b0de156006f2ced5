"""Periodic runs against comparing every word with every later one."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwise.llm import periodic
from keepwise.llm.queries import op13_periodic_runs
from tests.conftest import SF001
from tests.llm.conftest import empty


def slow_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def slow_collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def test_transform_is_a_convolution():
    rng = np.random.default_rng(3)
    for size in (1, 2, 8, 64):
        a, b = (rng.integers(0, periodic.PRIME, (size, 3)) for _ in range(2))
        got = periodic.ntt(periodic.ntt(a) * periodic.ntt(b) % np.uint64(periodic.PRIME), inverse=True)
        for c in range(3):
            want = [sum(int(a[i, c]) * int(b[(k - i) % size, c]) for i in range(size)) % periodic.PRIME for k in range(size)]
            assert got[:, c].tolist() == want


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(250):
        n = rng.randint(0, 160)
        letters = rng.choice([1, 2, 2, 3, 6, 30])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 5 else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a, rng.randint(a, n)):
                words[i] = words[a + (i - a) % p]
        least = rng.choice([12, 12, 12, 2, 4, 5, 6, 30])
        runs = periodic.runs_of(np.array(words, np.int64), least)
        assert runs == slow_runs(words, least)
        kept = [words[i] for i in periodic.collapsed(n, runs).tolist()]
        assert kept == slow_collapsed(words, runs)


def test_words_of_sequences_with_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic.runs_of(np.array(b)) == slow_runs(b)
    assert periodic.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic.runs_of(np.arange(200_000) % 70_001) == [(0, 200_000, 70_001)]


def test_a_sum_that_is_zero_only_modulo_the_prime_leaves_no_run(monkeypatch):
    monkeypatch.setattr(periodic, "PRIME", 257)
    monkeypatch.setattr(periodic, "GENERATOR", 3)
    periodic._stages.cache_clear()
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.randrange(200) for _ in range(60)]
        words[20:60] = [words[20 + i % 7] for i in range(40)]
        assert periodic.runs_of(np.array(words)) == slow_runs(words)
    periodic._stages.cache_clear()


def test_odd_rows(spark, odd):
    found = periodic.find_runs(odd.withColumn("runs", F.lit("mine")).withColumn("__text0", F.lit(1)), least=12)
    assert found.columns == [*odd.columns, "__text0", "n_words", "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert r["n_words"] == len(words) and r["score"] is not None
        if len(words) < 1000:
            runs = slow_runs(words)
            assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == " ".join(slow_collapsed(words, runs))
        else:
            assert [tuple(x) for x in r["runs"]] == [(0, 30_000, 1)] and r["collapsed"] == "word"
    assert periodic.find_runs(empty(odd)).count() == 0
    # texts searched together don't meet: equal rows have no run across them
    line = "a b c d e f g h"
    same = spark.createDataFrame([(i, line) for i in range(50)], "doc_id long, text string").coalesce(1)
    assert all(r["runs"] == [] for r in periodic.find_runs(same).collect())


def test_query_against_brute_force(spark):
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n = len(words)
        if n > 1500:
            continue  # brute force is quadratic
        h = zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs, r = slow_runs(words), got[d["doc_id"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], (r["start"], r["length"], r["period"])) == (len(runs), best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(slow_collapsed(words, runs)).encode()).hexdigest()
    assert planted > 5
