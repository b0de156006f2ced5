"""Spelling variants against comparing all words, and the filters alone."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwise.llm import spelling
from tests.llm.conftest import empty


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[w] = best
        out[w] = len(found)

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, out[w], counts.get(form.get(w))) for w, n in counts.items()}


def some_words(seed, count, letters="abcé÷Àz"):
    rng = random.Random(seed)
    out = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))): rng.choice([1, 1, 2, 5, 10, 50, 250, 1250]) for _ in range(count)}
    return out


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("seed,max_blocks", [(1, spelling.MAX_BLOCKS), (2, spelling.MAX_BLOCKS), (3, 1)])
def test_variants(spark, seed, max_blocks):
    # one block for all lengths is a filter that lets nearly everything pass: the result is the same
    counts = some_words(seed, 220)
    got = spelling.variants(table(spark, counts), max_blocks=max_blocks)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == slow_variants(counts)


def test_long_ways_and_ties(spark):
    # counts five times larger at each step; two near words of equal count
    chain = {"a" * 6 + "b" * i: 5 ** (i + 1) for i in range(9)}
    counts = {**chain, "zzzzzx": 100, "zzzzzy": 100, "zzzzz": 3, "élève": 50, "élèvê": 5, "eleves": 7}
    got = {r["word"]: r for r in spelling.variants(table(spark, counts)).collect()}
    assert {tuple(got[w][c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for w in counts} == slow_variants(counts)
    assert got["aaaaaa"]["root"] == "aaaaaa" + "b" * 8 and got["zzzzz"]["form"] == "zzzzzx"
    assert got["eleves"]["form"] is None and got["eleves"]["n_near"] == 0


def test_filters_say_no_only_to_strangers(spark):
    counts = some_words(9, 3000, "abcdefghij")
    lengths = Counter(map(len, counts))
    sizes = spelling.filter_sizes(lengths)
    filters = spelling.build_filters(table(spark, counts), sizes)
    strange = total = 0
    for size, held in filters.items():
        assert held.shape == (sizes[size], spelling.LANES)
        own = [w for w in counts if len(w) == size]
        assert spelling.maybe_in(held, spelling._codes(own) @ spelling._powers(size)).all()
        others = ["".join(chr(ord(c) + 12) for c in w) for w in own]
        strange += int(spelling.maybe_in(held, spelling._codes(others) @ spelling._powers(size)).sum())
        total += len(own)
    assert strange < total / 20
    assert sum(spelling.filter_sizes({i: 10**9 for i in range(5, 30)}).values()) <= spelling.MAX_BLOCKS


def test_every_edit_is_probed_once():
    words = ["abc", "aab", "ccc", "baÿ"]
    letters = np.array(sorted({ord(c) for w in words for c in w}), np.uint64)
    everything = {n: np.full((1, spelling.LANES), ~np.uint64(0)) for n in (2, 3)}
    got = Counter(spelling.passing_edits(words, everything, letters))
    assert set(got.values()) == {1}
    for i, w in enumerate(words):
        less = {w[:k] + w[k + 1:] for k in range(3)}
        other = {w[:k] + chr(int(c)) + w[k + 1:] for k in range(3) for c in letters if int(c) > ord(w[k])}
        assert {e for j, e in got if j == i} == less | other


def test_counting_odd_rows(spark, odd):
    rows = odd.withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).withColumn("key", F.lit(3))
    got = {r["word"]: r["n"] for r in spelling.count_words(rows, least_letters=1, least_count=1).collect()}
    want = Counter()
    for r in odd.collect():
        run = ""
        for c in (r["text"] or "") + " ":
            if "A" <= c <= "Z":
                c = c.lower()
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                want[run] += 1
                run = ""
    assert got == dict(want)
    assert spelling.variants(spelling.count_words(empty(odd))).count() == 0
    everywhere = spelling.count_words(odd.where("text = 'one'"), drop_every=1, least_letters=1, least_count=1).collect()
    assert len(everywhere) == 1 and len(everywhere[0]["word"]) == 2


def test_many_words_in_a_task_are_written_in_parts(spark, odd, monkeypatch):
    whole = {tuple(r) for r in spelling.count_words(odd, least_count=1).collect()}
    monkeypatch.setattr(spelling, "HELD_WORDS", 1)
    assert {tuple(r) for r in spelling.count_words(odd, least_count=1).collect()} == whole
