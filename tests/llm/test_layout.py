"""Packing, WARC, mixing, sharding and top-k against plain versions."""
import hashlib
import io
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwise.llm import mixing, packing, sharding, top_k, warc
from keepwise.llm.queries import TOKENIZER
from tests.conftest import SF001
from tests.llm.conftest import empty

# ---- packing


def slow_pack(text, tokenizer, context):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    out, at = [], 0
    while at < len(ids):
        size = min(context, 1 << ((len(ids) - at).bit_length() - 1))
        raw = np.array(ids[at:at + size], "<u4").tobytes()
        out.append((at, size, zlib.crc32(raw), len(ids)))
        at += size
    return out


@pytest.mark.parametrize("context", [4096, 64])
def test_packing(spark, docs001, odd, context):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    for df in (docs001, odd):
        rows = packing.pack(df, TOKENIZER, context=context).collect()
        want = [(r.doc_id, *p) for r in df.collect() for p in slow_pack(r.text, t, context)]
        assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=str) == sorted(want, key=str)
        assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
        assert all(r.length & (r.length - 1) == 0 and r.length == len(r.ids) <= context for r in rows)
    assert packing.pack(empty(odd), TOKENIZER).count() == 0


def test_word_memory_is_exact(monkeypatch):
    words = packing.WordTokens(TOKENIZER)
    texts = ["<|endoftext|>x| it's don't. 'S a|b ΑΣ. İx! é. 12,3 a_b.   x\x1cz \x85 ﬁ. Ⅷ. ª. x<|startoftext|>!", "naïve... Straße!! ñ; ́. 日本語。 ǅ. 'll 'LL. a'LL? ŉ Œuvre Ÿ"]
    for limit in (packing.REMEMBER, 3):
        monkeypatch.setattr(packing, "REMEMBER", limit)
        for text in texts:
            assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_buckets_on_disk(spark, docs001, tmp_path):
    packing.write_buckets(packing.pack(docs001, TOKENIZER), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("bucket <> length OR size(ids) <> length").count() == 0


def test_context_is_a_power_of_two(odd):
    with pytest.raises(ValueError):
        packing.pack(odd, TOKENIZER, context=1000)


# ---- WARC

PAGES = [
    (1, "http://a/ü b", "x" * 1000), (2, "http://b", "x" * 1000), (3, None, "x" * 1000), (4, "u", "short"), (5, "u", "short"),
    (6, "u", None), (7, "u", ""), (None, "u", "x" * 1000), (8, "u\r\nX: y", "é" * 500), (9, "u", "é" * 500), (9, "u", "é" * 500),
    (10, "u", "r\r\n\r\nWARC/1.1\r\n\r\n" * 100), (11, "u", "z" * 3_000_000),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, record_type string")
    rows = warc.round_trip(pages, with_payload=True).collect()
    assert len(rows) == len(PAGES)
    want = []
    for page, url, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == raw and p is not None]
        head = max(same) if len(raw) >= 1000 and max(same) != page else None
        want.append((page, url, "revisit" if head else "response", head, len(raw), hashlib.sha1(raw).hexdigest(), None if head else raw))
    assert sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in rows), key=str) == sorted(want, key=str)
    assert warc.round_trip(empty(pages)).count() == 0


def test_reader_is_sequential_and_checks():
    raws = [warc.make_record(i, f"http://x/{i}", bytes([65 + i]) * 5000) for i in range(5)]
    archive = b"".join(raws)
    assert [warc.parse_record(m)[2] for m in warc.members(io.BytesIO(archive), step=7)] == [bytes([65 + i]) * 5000 for i in range(5)]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(archive[:-3])))
    text = next(warc.members(io.BytesIO(raws[0])))
    for broken in (text.replace(b"AAAA", b"BAAA", 1), text[:-1], text.replace(b"Content-Length: 50", b"Content-Length: 49"), b"x" + text):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


def test_small_files(spark):
    pages = spark.createDataFrame([(i, "u", "y" * 2000 + str(i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    from keepwise.llm.common import shared_path

    folder = shared_path(spark, "warc-test")
    manifest = warc.write(pages.withColumn("refers_to", F.lit(None)), folder, file_bytes=500)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == 40
    assert warc.read(manifest, folder).count() == 40


# ---- mixing


def slow_targets(sizes, epochs=2, budget=Fraction(3, 2)):
    """Capped shares by rounds over sources in order (null last)."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, left = {}, budget * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        if not rest:
            return capped
        level = (left - sum(capped.values())) / Fraction(sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] >= epochs * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in rest}
        capped |= {s: Fraction(epochs * sizes[s]) for s in over}


def check_mix(df, rows):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = slow_targets(sizes)
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(float(want[s]), rel=1e-12) for r in mine)
        assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in mine)
        assert abs(sum(r.taken for r in mine) - float(want[s])) <= largest[s] / 2 + 1e-6
    assert len(rows) == df.count()


def test_mixing(spark, docs001):
    from keepwise.llm.queries import op7_mixing

    rows = mixing.mix(docs001).collect()
    check_mix(docs001, rows)
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in docs001.collect()}
    again = op7_mixing(spark, SF001).collect()
    assert all(r["size"] == sizes[r.doc_id] for r in again)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_comes_near(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(1, 300)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    gaps = {r.source: abs(r.taken - r.target) for r in got}
    assert max(gaps.values()) <= 20, gaps  # rows have 150 words on average


def test_mixing_odd_rows(spark, odd):
    rows = mixing.mix(odd.where("doc_id <> 8 OR doc_id IS NULL")).collect()
    check_mix(odd.where("doc_id <> 8 OR doc_id IS NULL"), rows)
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(empty(odd)).count() == 0
    assert mixing.repeat(empty(odd)).columns == odd.columns
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]


def test_repeat_agrees_with_mix(spark, docs001):
    want = {r.doc_id: r.times for r in mixing.mix(docs001).collect()}
    got = {}
    for r in mixing.repeat(docs001).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


# ---- sharding


def test_sharding(spark, docs001, odd):
    from keepwise.llm.queries import op8_sharding

    texts = {r.doc_id: r.text for r in docs001.collect()}
    rows = op8_sharding(spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16)
    for df in (docs001, odd):
        by = {}
        for r in sharding.shard(df, shards=3).collect():
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == df.count()
    assert sharding.shard(empty(odd)).count() == 0


def test_growth_moves_rows_only_into_the_new_shard(spark, docs001):
    for n in (1, 4, 16):
        small = {r.doc_id: r for r in sharding.shard(docs001, n).collect()}
        large = {r.doc_id: r.shard for r in sharding.shard(docs001, n + 1).collect()}
        assert all(large[k] == r.grown_shard for k, r in small.items())
    held = sharding.slot_map(16)
    counts = np.bincount(held)
    assert len(counts) == 16 and counts.max() - counts.min() <= 1


def test_hot_id_and_repeated_rows(spark):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), (F.col("id") % 1000).cast("string").alias("text"))
    rows = sharding.shard(df).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(3000))


def test_versioned_map(spark, docs001, tmp_path):
    path = str(tmp_path / "map")
    held = sharding.slot_map(4, 256)
    sharding.save_map(sharding.map_table(spark, held, 1), path)
    sizes = {r.virtual_slot: r.bytes for r in sharding.slot_sizes(docs001, slots=256).collect()}
    edited = sharding.rebalance(held, sizes)
    sharding.save_map(sharding.map_table(spark, edited, 2), path)
    assert sharding.load_map(spark, path, 1) == held and sharding.load_map(spark, path) == edited

    def spread(m):
        weights = [sum(sizes.get(s, 0) for s in range(256) if m[s] == k) for k in range(4)]
        return max(weights) - min(weights)

    assert spread(edited) < spread(held)
    assert {r.shard for r in sharding.shard(docs001, held=edited).collect()} <= set(range(4))


def test_sharding_is_native(docs001):
    plan = sharding.shard(docs001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- top-k


def slow_top(vectors, queries, k):
    good = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(good):
        if queries(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(good) if n != at and len(b) == len(a))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def top_rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("tile,block", [(1024, 32 << 20), (16, 4096)])
def test_top_k(spark, monkeypatch, tile, block):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(20, 24))
    rows = [(i, (centers[i % 20] + 0.2 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(700 + i, rows[i][1]) for i in range(50)]  # ties
    rows += [(800, None), (850, [float("nan")] * 24), (900, [None] * 24), (None, rows[0][1]), (950, [float("inf")] * 24),
             (1000, [1.0, 2.0]), (1050, [2.0, 1.0]), (1100, []), (1150, []), (100, rows[100][1]), (150, rows[3][1])]  # ids twice
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    monkeypatch.setattr(top_k, "TILE", tile)
    monkeypatch.setattr(top_k, "BLOCK_BYTES", block)
    assert top_rows(top_k.top_k(df, F.col("vec_id") % 50 == 0, k=5)) == slow_top(rows, lambda i: i % 50 == 0, 5)


def test_top_k_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>, score long"
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], schema)
    assert top_rows(top_k.top_k(df, F.col("vec_id") % 50 == 0)) == [(0, 1, 1, 256 * 512)]
    assert top_k.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    same = spark.createDataFrame([(0, [1.0], 1)] * 2, schema)  # each row is the other's candidate
    assert top_rows(top_k.top_k(same, F.col("vec_id") == 0)) == [(0, 1, 0, 256 * 256)] * 2


def searched(vectors, queries, tile=200):
    at = np.arange(len(vectors))
    block = top_k.Block(at[queries], at[queries], vectors[queries], 5)
    for i in range(0, len(at), tile):
        block.offer(at[i:i + tile], at[i:i + tile], vectors[i:i + tile])
    exact = vectors[queries] @ vectors.T
    exact[np.arange(len(block.ids)), at[queries]] = -(2**62)
    assert np.array_equal(block.score, -np.sort(-exact, axis=1)[:, :5])
    return block


@pytest.mark.parametrize("dim", [1, 2, 3, 15, 32, 33])
def test_bounds_hold(dim):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(50, dim)), rng.normal(size=(60, dim)) * 3
    axes = top_k.rotation(a)
    exact, last = a @ b.T, None
    for edges in top_k.resolutions(dim):
        assert edges[0] == 0 and edges[-1] == dim and (np.diff(edges) > 0).all()
        bound = top_k.segment_stats(a @ axes, edges) @ top_k.segment_stats(b @ axes, edges).T
        assert (bound >= exact - 1e-9).all()
        assert last is None or (bound <= last + 1e-9).all()
        last = bound


def test_bounds_prune():
    rng = np.random.default_rng(10)
    base = np.repeat(np.eye(4), 16, axis=1) * 100
    vectors = np.vstack([base[i % 4] * (1 + i % 7) + rng.integers(-2, 3, 64) for i in range(2000)]).astype(np.int64)
    block = searched(vectors, np.arange(4))
    assert block.exact_pairs < 0.05 * block.pairs
    assert block.level_pairs[-1] < 0.5 * block.pairs


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_bounds_prune_the_given_vectors(table):
    """Directions without structure: pairs and single dimensions do the pruning."""
    import pyarrow.parquet as pq

    column = pq.read_table(f"/root/testdata/{table}/embeddings.parquet", columns=["embedding"])["embedding"]
    vectors = np.floor(256 * np.array(column.to_pylist())).astype(np.int64)
    block = searched(vectors, np.arange(0, len(vectors), 50), tile=1024)
    assert block.exact_pairs < 0.06 * block.pairs


def test_large_components_stay_exact():
    big = np.array([[2**27, 1], [2**27, 2], [2**27, 3]], np.int64)
    block = top_k.Block(np.arange(1), np.array([9]), np.array([[2**27, 1]], np.int64), 2)
    block.offer(np.arange(1, 4), np.arange(3), big)
    assert block.rows_out()[3].tolist() == [2**54 + 3, 2**54 + 2]


def test_equal_rows_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    df = spark.createDataFrame([(5, "same")] * 100 + [(i, "x") for i in range(20)] + [(None, None)] * 9, "doc_id long, text string")
    rows, by = sharding.shard(df, shards=3).collect(), {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 129 and sum(r.doc_id == 5 for r in rows) == 101
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_stored_map_places_the_rows(spark, docs001, tmp_path):
    from keepwise.llm import sharding

    path = str(tmp_path / "map")
    rows = sharding.shard(docs001, shards=16, store=path)
    plain = sharding.shard(docs001, shards=16)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain.collect()))
    held = sharding.slot_map(16)
    assert sharding.load_map(spark, path, 1) == held and sharding.load_map(spark, path) == sharding.grow(held, 16)
    want = {r["virtual_slot"]: (r["rows"], r["bytes"]) for r in sharding.slot_sizes(docs001).collect()}
    for version in (1, 2):
        stored = spark.read.parquet(path).where(f"version = {version}").collect()
        assert {r["virtual_slot"]: (r["rows"], r["bytes"]) for r in stored if r["rows"]} == want and len(stored) == sharding.SLOTS
    # the stored sums are what a map is edited by
    slot_bytes = {s: b for s, (_, b) in want.items()}
    weight = lambda m: [sum(slot_bytes.get(s, 0) for s, x in enumerate(m) if x == shard) for shard in range(16)]
    edited = sharding.rebalance(held, slot_bytes)
    assert max(weight(edited)) <= max(weight(held))
