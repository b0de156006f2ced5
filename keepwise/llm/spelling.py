"""Spelling variant grouping (operator 11) by Bloom-guided neighbourhoods.

The vocabulary is counted, then put into one blocked Bloom filter per word
length, of a fixed size at most, which is broadcast. Each word's edits are
generated and probed there, by rolling hashes and without building a string.
Only edits that the filter lets pass become rows; they meet the vocabulary in
an exact join, which removes the filter's false positives. A filter too small
for its words only lets more edits pass.

Of a pair of near words one side generates the other: the longer one deletes,
and of two words of one length the one with the smaller differing letter
replaces it. The alphabet is that of the vocabulary.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import in_slices, staged, utf8

#: maximal runs of Latin letters (the range holds the two signs as well)
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: 64-bit words of a block of the filter: a cache line
LANES = 8
#: bits set per word, each in a lane of its own
PROBES = 6
#: bits of filter per word while they fit
BITS_A_WORD = 16
#: blocks of all filters together at most: 128 MB
MAX_BLOCKS = 1 << 21
#: distinct words a task holds before it writes their counts
HELD_WORDS = 200_000
#: edits probed at a time
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


# --- words and their counts ---------------------------------------------------------

def lower_ascii(text: bytes) -> str:
    """``text`` with A-Z in lower case; other letters stay as they are."""
    return text.lower().decode("utf-8", "replace")  # bytes.lower() knows ASCII only


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", drop_every: int | None = None,
                least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the letter runs of all whole texts, A-Z in lower case.

    With ``drop_every``, a run loses the letter ``h % length`` if h, the CRC-32
    of ``<key>:<run>``, is a multiple of it (a planted misspelling). Words of
    fewer letters or occurrences are left out. Null texts have no word, a null
    key is an empty text; repeated rows count each.

    Tasks count before they shuffle, so a frequent word is a row per task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows_out() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for part in in_slices(batch, "text", 8 << 20):
                for k, t in zip(part.column("key").to_pylist(), part.column("text")):
                    if not t.is_valid:
                        continue
                    begin = zlib.crc32(f"{k}:".encode())
                    for w, n in Counter(RUN.findall(lower_ascii(t.as_buffer().to_pybytes()))).items():
                        if drop_every and (h := zlib.crc32(w.encode(), begin)) % drop_every == 0:
                            w = w[:h % len(w)] + w[h % len(w) + 1:]
                        if len(w) >= least_letters:
                            held[w] += n
                    if len(held) >= HELD_WORDS:
                        yield rows_out()
        yield rows_out()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), utf8(text).alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


# --- hashes -----------------------------------------------------------------------------

def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The bits of sums of letters times powers, well mixed."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _bits(h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(lane, mask) of each bit that a word sets in its block."""
    first = (h >> np.uint64(20)).astype(np.int64)  # apart from the bits that choose the block
    for i in range(PROBES):
        yield (first + i) % LANES, np.uint64(1) << (_mixed(h + np.uint64(i + 1)) & np.uint64(63))


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return (h & np.uint64(blocks - 1)).astype(np.int64)


# --- the filters ----------------------------------------------------------------------------

def filter_sizes(lengths: dict[int, int], max_blocks: int = MAX_BLOCKS) -> dict[int, int]:
    """Blocks (a power of two) of each length's filter, from its words.

    Together they stay within ``max_blocks``: beyond it, all shrink alike.
    """
    want = {size: max(1, n * BITS_A_WORD / (64 * LANES)) for size, n in lengths.items()}
    share = min(1.0, max_blocks / 2 / max(sum(want.values()), 1))  # rounding up may double them
    return {size: 1 << max(0, int(np.ceil(np.log2(max(1.0, x * share))))) for size, x in want.items()}


def build_filters(words: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """One blocked Bloom filter per word length: an array of (blocks, lanes).

    Blocks are filled where the words are and united by a bitwise OR per
    block; what reaches the driver is the blocks in use, whose number
    ``filter_sizes`` bounds whatever the words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[str]] = {}
            for w in batch.column("word").to_pylist():
                by.setdefault(len(w), []).append(w)
            for size, own in by.items():
                h = _mixed(_codes(own) @ _powers(size))
                block, at = np.unique(_block(h, sizes[size]), return_inverse=True)
                filled = np.zeros((len(block), LANES), np.uint64)
                for lane, mask in _bits(h):
                    np.bitwise_or.at(filled, (at, lane), mask)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(block), size, np.int32)), pa.array(block.astype(np.int32))]
                    + [pa.array(filled[:, i].view(np.int64)) for i in range(LANES)], names=names)

    lanes = [f"lane{i}" for i in range(LANES)]
    names = ["size", "block", *lanes]
    parts = words.select("word").mapInArrow(run, "size int, block int, " + ", ".join(f"{c} long" for c in lanes))
    united = parts.groupBy("size", "block").agg(*[F.bit_or(c).alias(c) for c in lanes]).toPandas()
    filters = {size: np.zeros((blocks, LANES), np.uint64) for size, blocks in sizes.items()}
    for size, rows in united.groupby("size"):
        filters[size][rows["block"].to_numpy()] = rows[lanes].to_numpy(np.int64).view(np.uint64)
    return filters


def maybe_in(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter may hold the words of these hashes (never a false no)."""
    h = _mixed(h)
    block, out = _block(h, len(held)), np.ones(len(h), bool)
    for lane, mask in _bits(h):
        out &= (held[block, lane] & mask) != 0
        if not out.any():
            break
    return out


# --- edits ------------------------------------------------------------------------------------

def passing_edits(words: list[str], filters: dict[int, np.ndarray], letters: np.ndarray) -> Iterator[tuple[int, str]]:
    """(index of the word, edit) for the edits of words of one length that a filter lets pass."""
    size = len(words[0])
    rows = max(1, CHUNK // (size * (len(letters) + 1)))
    for first in range(0, len(words), rows):
        own = words[first:first + rows]
        codes, powers = _codes(own), _powers(size)
        terms = codes * powers
        whole = terms.sum(axis=1, dtype=np.uint64)
        if size - 1 in filters:  # without letter i: what follows moves one power down
            upto = np.cumsum(terms, axis=1, dtype=np.uint64)
            short = upto - terms + (whole[:, None] - upto) * _BASE_INVERSE
            new = np.ones(codes.shape, bool)
            new[:, 1:] = codes[:, 1:] != codes[:, :-1]  # of equal neighbours one deletion is enough
            w, i = np.nonzero(new)
            hit = maybe_in(filters[size - 1], short[w, i])
            for word, at in zip(w[hit].tolist(), i[hit].tolist()):
                yield first + word, own[word][:at] + own[word][at + 1:]
        if size in filters:
            w, i, c = np.nonzero(letters[None, None, :] > codes[:, :, None])
            h = whole[w] + (letters[c] - codes[w, i]) * powers[i]
            hit = maybe_in(filters[size], h)
            for word, at, letter in zip(w[hit].tolist(), i[hit].tolist(), letters[c[hit]].tolist()):
                yield first + word, own[word][:at] + chr(letter) + own[word][at + 1:]


def near_pairs(words: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(word, n, near, near_n): both directions of each pair of ``words`` (word, n)
    that differ by one letter inserted, deleted or replaced.

    ``words`` are distinct, and read several times: stage them first. A word
    has few near words, whatever its count, so no key is hot.
    """
    spark = words.sparkSession
    lengths = {r["size"]: r["n"] for r in words.where(F.length("word") > 0).groupBy(F.length("word").alias("size"))
               .agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    alphabet = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct()
    letters = np.array(sorted(ord(r["letter"]) for r in alphabet.collect()), np.uint64)  # of a fixed script
    filters = spark.sparkContext.broadcast(build_filters(words.where(F.length("word") > 0), filter_sizes(lengths, max_blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, tuple[list[str], list[int]]] = {}
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if w:
                    own = by.setdefault(len(w), ([], []))
                    own[0].append(w)
                    own[1].append(n)
            for own, counts in by.values():
                edits = passing_edits(own, filters.value, letters)
                while found := list(islice(edits, HELD_WORDS)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own[i] for i, _ in found], pa.string()), pa.array([counts[i] for i, _ in found], pa.int64()),
                         pa.array([e for _, e in found], pa.string())], names=["word", "n", "near"])

    # the counted words are few large files: every core takes a share of the edits
    positives = words.select("word", "n").repartition(spark.sparkContext.defaultParallelism * 2, "word").mapInArrow(
        run, "word string, n long, near string")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = positives.join(known, "near").select("word", "n", "near", "near_n")
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"),
                             F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(both.alias("pair")).select("pair.*")


# --- forms and roots -----------------------------------------------------------------------------

def variants(words: DataFrame, ratio: int = 5, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """A row per word of ``words`` (word, n; distinct): form, root, n, n_near and form_n.

    The form is the near word with the largest n (ties: the smallest in code
    point order), if that is at least ``ratio`` times the word's; else null.
    The root is where forms lead from the word. Counts grow along the way, so
    there is no ring and a way has at most log(largest n) steps; halving it
    each round takes a join of the words that have a form.
    """
    words = staged(words.select("word", "n"), "words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    grouped = near_pairs(words, max_blocks).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = F.col("best.near_n") >= F.lit(ratio) * F.col("n")
    judged = staged(words.join(grouped, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("best.near_n")).alias("form_n")), "forms")
    ways = judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(ways.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        ways = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return judged.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
