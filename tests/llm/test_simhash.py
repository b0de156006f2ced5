import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keepwise.llm import simhash
from tests.llm.conftest import TEXTS, empty


def slow_print(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, bits=3):
    """Smallest id of each row's component, all pairs compared."""
    rows = list(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= bits:
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), k) if x is not None), default=None)
    return [low[find(i)] for i in range(len(rows))]


def compare(df, out):
    rows = [(r.doc_id, slow_print(r.text)) for r in df.select("doc_id", "text").collect()]
    want = sorted(((k, f"{p:016x}", c) for (k, p), c in zip(rows, slow_components(rows))), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()), key=str) == want


def test_odd_documents(odd):
    compare(odd, simhash.near_duplicates(odd))


def test_whole_table(spark, docs001):
    from keepwise.llm.queries import op1_simhash_near_dedup
    from tests.conftest import SF001

    compare(docs001, op1_simhash_near_dedup(spark, SF001))


def test_empty_table(odd):
    assert simhash.near_duplicates(empty(odd)).count() == 0
    assert simhash.one_of_each(empty(odd)).columns == odd.columns


@pytest.mark.parametrize("group", [4096, 3])
def test_links_connect_dense_groups(spark, group):
    """A chain and a ball of close fingerprints; with a small limit, keys are dealt again."""
    rng = np.random.default_rng(1)
    center = int(rng.integers(0, 1 << 62))
    fps = {center}
    for _ in range(120):
        fps.add(center ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    chain = int(rng.integers(0, 1 << 62))
    for i in range(0, 60, 3):
        fps.add(chain)
        chain ^= 0b111 << i
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    fps = [simhash._signed(x) for x in fps]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(fps)], "fp long, doc_id long").repartition(3)
    links = simhash.links(df.select("fp"), 3, group)
    assert links.count() <= 20 * len(fps)
    comp = {r.node: r.root for r in simhash.components(links).collect()}
    got = [comp.get(x, x) for x in fps]
    low = slow_components([(x, x & (2**64 - 1)) for x in fps])
    assert got == low


def test_masks_leave_no_pair_out():
    rng = np.random.default_rng(2)
    masks = simhash.block_masks(3)
    assert len(masks) == 20
    for _ in range(500):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        mask = [m for m in masks if not diff & m]
        assert mask
        assert all(any(not diff & s for s in simhash.second_masks(m, 3)) for m in mask)


def test_one_of_each(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    groups = simhash.near_duplicates(odd)
    assert kept.count() == groups.select("root").distinct().count()
    ids = {r.doc_id for r in kept.collect()}
    assert {r.component_id for r in groups.collect()} == ids
    assert len(TEXTS) == 13


def test_long_text_in_steps(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "STEP", 100)
    assert simhash.fingerprint(text.encode()) == whole == slow_print(text)


def test_spark_hash_agrees(spark):
    text = "some three words"
    got = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_isolated_pairs_that_differ_in_the_sign_bit():
    """Every difference of one to four bits with bit 63: linked up to three bits, not at four."""
    rng = np.random.default_rng(6)
    for more in range(4):
        for low in combinations(range(63), more):
            a = int(rng.integers(0, 1 << 63))
            b = a ^ sum(1 << i for i in (63, *low))
            pair = np.array([a, b], np.uint64).view(np.int64)
            want = ([int(pair[0])], [int(pair[1])]) if more < 3 else ([], [])
            assert simhash._tree(pair, 3) == want, (63, *low)
