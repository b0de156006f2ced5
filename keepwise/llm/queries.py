"""The registered queries: each operator over its whole table.

``QUERIES`` maps a name to a function of (spark, sf_dir), ``ORACLES`` to DuckDB
SQL where SQL can express the result. Fingerprints (XXH64), tokenizer ids,
CRC-32, learned models and seeded hashes have no such SQL; tests compare those
queries with brute force.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.llm import (
    chat, licences, mixing, packing, periodic, quality_rules, secret_scan, sharding, simhash, spelling, top_k, toxicity, warc,
)
from keepwise.llm.common import read_table, shared_path, staged

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def held_out(doc_id: str = "doc_id") -> Column:
    """Ids whose labels are never learned from (null ids are not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, shingle=3, bits=3).select("doc_id", "fingerprint", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, held_out=held_out())
    return toxicity.score(docs, model, keep=["doc_id"]).withColumn("held_out", held_out())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(quality_rules.with_stats(read_table(spark, sf_dir, "documents"), keep=["doc_id"]), "stats")
    rules = quality_rules.fit(stats, read_table(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), TOKENIZER, context=4096, end_id=2, with_ids=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), least=1000).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), shards=16, store=shared_path(spark, "slot-map"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    words = spelling.count_words(docs, drop_every=199, least_letters=6, least_count=5)
    return spelling.variants(words, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    chats = chat.format_chats(rows.select("conv_id", "turn", "role", chat.text_part("text").alias("parts")))
    turns, learned = chat.read_turns(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    read = chats.select("conv_id", "formatted_chars", turns.alias("turns"), learned.alias("learned"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), chat.text_of(t["parts"]), F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """``text``, of a tenth of the ids repeated from a word on with a period; ids and length decide all."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1)).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the words pass through an array of one, so that they are cut once and not for each word
    return F.when(h % 10 == 0, F.array_join(F.transform(F.array(words), repeated)[0], " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.find_runs(docs, keep=["doc_id"], least=12)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digests = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("best.less"), F.col("best.period")
    return digests.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_toxicity, op3_quality_rules, op4_secret_scan, op5_packing, op6_warc, op7_mixing,
    op8_sharding, op9_top_k, op10_licence_scan, op11_spelling_variants, op12_chat_format, op13_periodic_runs)}

ORACLES = {
    "op6_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), h AS (
            SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
            CASE WHEN p.payload_bytes >= 1000 AND p.page_id IS DISTINCT FROM h.head AND h.head IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN p.payload_bytes >= 1000 AND p.page_id IS DISTINCT FROM h.head THEN h.head END AS refers_to
        FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest
    """,
    "op9_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.place <> c.place AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
    # CRC-32 by bytes, its table made by the rule; near words share a text that lacks a letter of each
    "op11_spelling_variants": """
        WITH RECURSIVE crc_table AS (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[],
                    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
                FROM range(256) r(i))
        ), found AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents
        ), counted AS (
            SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes, count(*) AS c FROM found GROUP BY 1, 2
        ), hashed AS (
            SELECT run, c, xor(4294967295::UBIGINT, list_reduce(
                [4294967295::UBIGINT] || list_transform(range(length(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS UBIGINT)),
                lambda h, b: xor(h >> 8, t[CAST(xor(h, b) & 255 AS BIGINT) + 1]))) AS h
            FROM counted CROSS JOIN crc_table
        ), changed AS (
            SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                ELSE run END AS word FROM hashed
        ), v AS (
            SELECT word, CAST(sum(c) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
        ), d AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM v)
        ), pairs AS (
            SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON d.rest = v.word
            UNION SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON d.rest = v.word
        ), best AS (
            SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
        ), formed AS (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
                CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
            FROM v LEFT JOIN best USING (word)
        ), ways AS (
            SELECT word, word AS root FROM formed
            UNION ALL SELECT ways.word, f.form FROM ways JOIN formed f ON f.word = ways.root WHERE f.form IS NOT NULL
        )
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN ways w ON w.word = f.word
            JOIN formed g ON g.word = w.root AND g.form IS NULL
    """,
    "op12_chat_format": r"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(t)
        ), e AS (
            SELECT *, length(role) + length(text) + length('<|turn|><|text|><|end|>') + list_sum(list_transform([role, text], lambda x:
                len(regexp_extract_all(x, '[<\[]\\*(/?INST\]|/?s>|unk>|pad>|\|(turn|text|end|image|audio|document|im_start|im_end|endoftext)\|>)')))) AS chars
            FROM r
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
