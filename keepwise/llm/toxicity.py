"""Toxicity: a learned lexicon in a trie, met by a Levenshtein automaton (operator 2).

The lexicon (words, and stems any word may begin with) is learned from labels;
words near a labelled word under a stem are hits of the stem.
A word is run through the automaton of all words within a few edits of the
lexicon: its states are sets of (trie node, edits so far), built when first
met, and most words leave it after two or three letters. Each hit is weighed
by what the labels say of that term at that distance; hits near other hits
count more (within eight words), hits inside quotations, followed through their
whole paragraph, are summed apart, and a logistic model of both sums gives the
score.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import map_documents, staged
from keepwise.operators.joins import fresh

#: code points stripped from both ends of a word
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’…¿¡"
#: quotations: straight marks at the outer side of words, curly and angle marks in pairs, single curly ones but no apostrophes
QUOTATION = re.compile(r'(?<!\w)"(?=\S)[^"]*(?<=\S)"(?!\w)|[“„][^“”„]*[”“]|«[^«»]*»|»[^«»]*«|(?<!\w)‘[^‘]*?’(?!\w)')
QUOTES = re.compile("[\"“„«»‘]")
PARAGRAPH = re.compile(r"\n\s*\n")
#: letters that other characters stand for inside a word
ALIKE = str.maketrans("013457@$!", "oieastasi")
WINDOW = 8


def _edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Words and stems in a trie, with the automaton of words near them.

    ``near`` are words under the stems: a word near one is a hit of its stem.
    """

    def __init__(self, words: list[str], stems: list[str] = (), most_states: int = 50_000, near: list[str] = ()):
        begin = set(stems)
        self.under = {w: next(f"{w[:k]}*" for k in range(len(w), 0, -1) if w[:k] in begin) for w in near}
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.reach = [0]  # edits that some word below allows
        for kind, terms in ((self.word, words), (self.word, near), (self.stem, stems)):
            for term in terms:
                at = 0
                for letter in term:
                    if kind is self.word:
                        self.reach[at] = max(self.reach[at], _edits(term))
                    if letter not in self.children[at]:
                        self.children[at][letter] = len(self.children)
                        for column, value in ((self.children, {}), (self.word, None), (self.stem, None), (self.reach, 0)):
                            column.append(value)
                    at = self.children[at][letter]
                kind[at] = term
                if kind is self.word:
                    self.reach[at] = max(self.reach[at], _edits(term))
        self.most_states = most_states
        self._reset()

    def _reset(self):
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of these (node, fewest edits), closed under left-out letters; -1 if none."""
        todo = [(n, e) for n, e in nodes.items() if e <= self.reach[n]]
        best = dict(todo)
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < best.get(child, 9):
                    best[child] = e + 1
                    todo.append((child, e + 1))
        if not best:
            return -1
        key = tuple(sorted(best.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def put(node, e):
            if e <= self.reach[node] and e < nodes.get(node, 9):
                nodes[node] = e

        for node, e in self.states[state]:
            for x, child in self.children[node].items():
                put(child, e + (x != letter))
            put(node, e + 1)  # a letter too many
        return self._state(nodes)

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, the first in order on ties; None if none is near."""
        if len(self.states) > self.most_states:
            self._reset()
        state, node, stem = self.start, 0, None
        for letter in word:
            if state >= 0:
                nxt = self.steps[state].get(letter)
                if nxt is None:
                    nxt = self._step(state, letter)
                    self.steps[state][letter] = nxt
                state = nxt
            if node >= 0:
                node = self.children[node].get(letter, -1)
                if node >= 0 and self.stem[node]:
                    stem = self.stem[node]
            if state < 0 and (node < 0 or stem):
                break
        if state >= 0:
            found = [(e, self.word[n]) for n, e in self.states[state] if self.word[n] and e <= _edits(self.word[n])]
            if found:
                e, term = min(found)
                if not stem or not e and term not in self.under:
                    return self.under.get(term, term), e
        return (f"{stem}*", 0) if stem else None


def core(word: str) -> str:
    """A lower-case word without marks at its ends, long runs of a letter cut to one."""
    word = word.strip(EDGE)
    if not word.isalpha():
        word = word.translate(ALIKE)
    for a, b, c in zip(word, word[1:], word[2:]):
        if a == b == c:
            out = word[:1]
            for x in word[1:]:
                if x != out[-1]:
                    out += x
            return out
    return word


class Finder:
    """Hits of a lexicon in texts, remembering words."""

    def __init__(self, lexicon: Lexicon, remember: int = 200_000):
        self.lexicon, self.remember, self.known = lexicon, remember, {}

    def _look(self, word: str):
        if len(self.known) >= self.remember:
            self.known.clear()
        hit = self.known[word] = self.lexicon.find(core(word))
        return hit

    def hits(self, raw: bytes) -> list[tuple[int, str, int, bool]]:
        """(place, term, edits, quoted) of the hits in a text, in order."""
        text = raw.decode("utf-8", "replace").lower()
        words = text.split()
        known, look, found = self.known, self._look, {}
        for word in set(words):
            hit = known[word] if word in known else look(word)
            if hit:
                found[word] = hit
        if not found:
            return []
        quoted = in_quotation(text)
        return [(i, *found[w], quoted is not None and quoted[i]) for i, w in enumerate(words) if w in found]


def in_quotation(text: str) -> list[bool] | None:
    """Whether each word of a text begins inside a quotation, however long; None if there is none.

    A quotation closes in the paragraph it opens in; a mark without its
    partner there is none.
    """
    if not QUOTES.search(text):
        return None
    spans, start = [], 0
    for end in [*(m.start() for m in PARAGRAPH.finditer(text)), len(text)]:
        spans += [m.span() for m in QUOTATION.finditer(text, start, end)]
        start = end
    if not spans:
        return None
    quoted, at = [], 0
    for m in re.finditer(r"\S+", text):
        first = m.end() - len(m.group().lstrip(EDGE))
        while at < len(spans) and spans[at][1] <= first:
            at += 1
        quoted.append(at < len(spans) and spans[at][0] < first)
    return quoted


@dataclass(frozen=True)
class Model:
    """What scoring needs; a few thousand terms, and the labelled words under the stems."""

    words: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    weights: dict = field(default_factory=dict)  # (term, edits) -> weight
    coefficients: tuple[float, ...] = (-3.0, 3.0, 0.0)
    near: tuple[str, ...] = ()  # words under the stems

    def finder(self) -> Finder:
        return Finder(Lexicon(self.words, self.stems, near=self.near))

    def sums(self, hits) -> tuple[float, float]:
        """Log of the window scores' sums: outside, inside quotation marks."""
        sums = [0.0, 0.0]
        weights = [self.weights.get((term, e), 0.0) for _, term, e, _ in hits]
        first = 0
        near = 0.0
        last = 0
        for i, (place, _, _, quoted) in enumerate(hits):
            while last < len(hits) and hits[last][0] <= place + WINDOW:
                near += weights[last]
                last += 1
            while hits[first][0] < place - WINDOW:
                near -= weights[first]
                first += 1
            sums[quoted] += weights[i] * (1 + 0.5 * min(3.0, max(0.0, near - weights[i])))
        return math.log1p(sums[0]), math.log1p(sums[1])

    def score(self, x: tuple[float, float]) -> float:
        z = self.coefficients[0] + self.coefficients[1] * x[0] + self.coefficients[2] * x[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counts(rows: DataFrame, make, key: str) -> DataFrame:
    """(key, c1, c0): rows of either label that have a key, counted in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of = make()
        ones, zeros = Counter(), Counter()

        def out():
            names = list(ones | zeros)
            return pa.RecordBatch.from_arrays([
                pa.array(names, pa.string()), pa.array([ones[k] for k in names], pa.int64()),
                pa.array([zeros[k] for k in names], pa.int64())], names=[key, "c1", "c0"])

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                (ones if toxic else zeros).update(keys_of(text.as_buffer().to_pybytes() if text.is_valid else b""))
                if len(ones) + len(zeros) > 1_000_000:
                    yield out()
                    ones.clear()
                    zeros.clear()
        yield out()

    parts = rows.select(F.col("text").cast("binary").alias("text"), "toxic").mapInArrow(run, f"{key} string, c1 long, c0 long")
    return parts.groupBy(key).agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def _candidates(words: list[str], stems: list[str], shortest: int = 4, longest: int = 10):
    """Keys of a row that no term so far explains: the empty one, its words and their beginnings."""
    find = Finder(Lexicon(words, stems))

    def keys(raw: bytes):
        if any(not e and not quoted for _, _, e, quoted in find.hits(raw)):
            return ()
        out = {""}
        for word in _unquoted(raw):
            if len(word) >= shortest and word[:longest].isalpha():
                out.update(word[:k] for k in range(shortest, min(len(word), longest) + 1))
                out.add(word + "$")
        return out

    return keys


def _unquoted(raw: bytes) -> set[str]:
    """The words of a text outside quotations; what is quoted says nothing of a term."""
    text = raw.decode("utf-8", "replace").lower()
    words, quoted = text.split(), in_quotation(text)
    if quoted is not None:
        words = [w for w, inside in zip(words, quoted) if not inside]
    return set(map(core, set(words)))


def _words_under(stems: list[str]):
    """Keys of a row: its whole words that begin with a stem."""
    begin, lengths = set(stems), sorted({len(s) for s in stems})

    def keys(raw: bytes):
        return {w for w in _unquoted(raw) if w.isalpha() and any(w[:k] in begin for k in lengths)}

    return keys


def stem_words(rows: DataFrame, stems: list[str], n1: int, n0: int, min_g2: float) -> list[str]:
    """The labelled words under the stems that would be terms by themselves, counted in all rows."""
    if not stems:
        return []
    table = _counts(rows, lambda: _words_under(stems), "word").where("c1 > 0.7 * (c1 + c0)").collect()
    return sorted(w for w, c1, c0 in table if _ratio(c1, c0, n1 / (n1 + n0)) >= min_g2)


def _ratio(c1: int, c0: int, base: float) -> float:
    """Likelihood ratio of a term's rows by label."""
    n = c1 + c0
    return 2 * (c1 * math.log(c1 / n / base) + (c0 * math.log(c0 / n / (1 - base)) if c0 else 0))


def choose_terms(table, n1: int, n0: int, min_g2: float, most: int) -> tuple[list[str], list[str]]:
    """Words and stems from (term, c1, c0), by likelihood ratio, none beginning another.

    Terms under an eighth of the best ratio wait for the next round, when
    the rows explained by now no longer count. On equal counts the longer
    term is taken, the whole word before a stem.
    """
    base = n1 / (n1 + n0)
    ranked = []
    for term, c1, c0 in table:
        g2 = _ratio(c1, c0, base)
        if c1 / (c1 + c0) > 0.7 and g2 >= min_g2:
            ranked.append((-round(g2, 6), -len(term), term))
    words, stems, taken, begun = [], [], set(), set()
    for g2, _, term in sorted(ranked):
        bare = term.removesuffix("$")
        if -g2 < -min(ranked)[0] / 8 or len(taken) >= most:
            break
        if bare in begun or any(bare[:k] in taken for k in range(1, len(bare) + 1)):
            continue
        (words if term.endswith("$") else stems).append(bare)
        taken.add(bare)
        begun.update(bare[:k] for k in range(1, len(bare) + 1))
    return words, stems


def learn_terms(rows: DataFrame, min_g2: float, most: int) -> tuple[list[str], list[str]]:
    """The lexicon, by covering: each round counts only rows without a term chosen before.

    Words that merely share documents (copies, say) with a chosen term so
    drop out. Rounds go on until one adds nothing. Candidates are judged where
    they are; those that pass reach the driver, the best 4 * ``most`` of them.
    """
    words, stems = [], []
    while len(words) + len(stems) < most:
        table = staged(_counts(rows, lambda w=tuple(words), s=tuple(stems): _candidates(w, s), "term").where(
            "c1 > 0.7 * (c1 + c0) OR term = ''"), "toxic-terms")
        left = table.where("term = ''").first()  # the rows without a term
        if left is None or not left["c1"] or not left["c0"]:
            break
        n1, n0 = left["c1"], left["c0"]
        c1, c0 = F.col("c1"), F.col("c0")
        ratio = 2 * (c1 * F.ln(c1 / (c1 + c0) / F.lit(n1 / (n1 + n0))) + F.when(c0 > 0, c0 * F.ln(c0 / (c1 + c0) / F.lit(n0 / (n1 + n0)))).otherwise(0.0))
        passing = table.where("term <> ''").withColumn("ratio", ratio).where(F.col("ratio") >= min_g2 - 1e-6)
        best = passing.orderBy(F.desc("ratio"), "term").limit(4 * most).collect()
        w, s = choose_terms([(r["term"], r["c1"], r["c0"]) for r in best], n1, n0, min_g2, most - len(words) - len(stems))
        if not w and not s:
            break
        words += w
        stems += s
    return words, stems


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's method on counted rows, ridge on all but the constant."""
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(b))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ b)
        b += np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return b


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int, held_out) -> DataFrame:
    """(text, toxic) of documents whose id has a label and is not held out."""
    ids = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("toxic"))
    if held_out is not None:
        ids = ids.where(~held_out)
    ids = ids.orderBy(F.xxhash64(doc_id), doc_id).limit(max_rows).select(F.col(doc_id).alias("__id"), "toxic")
    return docs.join(F.broadcast(ids), F.col(doc_id) == F.col("__id")).select(F.col(text).alias("text"), "toxic")


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    held_out=None, max_rows: int = 20_000, min_g2: float = 20.0, most_terms: int = 2000, ridge: float = 0.05,
) -> Model:
    """A model of ``label`` from at most ``max_rows`` labelled ids (smallest hashes first).

    ``held_out`` is a condition on ``doc_id`` that keeps rows out of training.
    A term needs a likelihood ratio of ``min_g2``. What reaches the driver: the best candidates
    of each round, the words under chosen stems, counts of chosen terms, and of binned sums. Without both
    labels the default model without terms is returned.
    """
    rows = staged(training_rows(docs, labels, doc_id, text, label, max_rows, held_out), "toxic-train")
    sizes = {bool(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return Model()
    words, stems = learn_terms(rows, min_g2, most_terms)
    near = sorted(set(stem_words(rows, stems, n1, n0, min_g2)) - set(words))

    def finder():
        return Finder(Lexicon(words, stems, near=near))

    def terms():
        find = finder()
        return lambda raw: {f"{term}\t{e}" for _, term, e, quoted in find.hits(raw) if not quoted}

    base = n1 / (n1 + n0)
    weights = {}
    for key, c1, c0 in _counts(rows, terms, "hit").collect():  # at most three a term
        term, e = key.split("\t")
        p = (c1 + 2 * 0.9) / (c1 + c0 + 2)  # before any count, a near term is believed
        weights[term, int(e)] = max(0.0, (math.log(p / (1 - p)) - math.log(base / (1 - base)))) / 4
    for term in words:
        for e in range(_edits(term) + 1):
            weights.setdefault((term, e), 0.5)
    for word, term in Lexicon([], stems, near=near).under.items():
        for e in range(1, _edits(word) + 1):
            weights.setdefault((term, e), 0.5)
    model = Model(tuple(words), tuple(stems), weights, near=tuple(near))

    def sums():
        find = finder()
        return lambda raw: [",".join(f"{min(40, round(4 * v))}" for v in model.sums(find.hits(raw)))]

    binned = _counts(rows, sums, "bin").collect()  # at most 41 * 41 rows
    x = np.array([[1.0, *(int(v) / 4 for v in key.split(","))] for key, _, _ in binned])
    n = np.array([c1 + c0 for _, c1, c0 in binned], float)
    y = np.array([c1 for _, c1, _ in binned]) / n
    b = _logistic(x, y, n, ridge)
    return Model(model.words, model.stems, weights, (float(b[0]), max(0.0, float(b[1])), max(0.0, float(b[2]))), model.near)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """``keep`` columns with score (0 to 1), predicted (1 from ``threshold`` on) and n_hits.

    Null and empty texts get the score of a text without hits. Repeated rows
    each give a row.
    """
    def make():
        find = model.finder()

        def one(raw: bytes) -> tuple:
            hits = find.hits(raw)
            value = model.score(model.sums(hits))
            return value, int(value >= threshold), len(hits)

        return one

    return map_documents(docs, make, "score double, predicted int, n_hits long", text, keep)


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, unchanged."""
    def make():
        find = model.finder()
        return lambda raw: (model.score(model.sums(find.hits(raw))) >= threshold,)

    name = fresh("__toxic", docs.columns)
    return map_documents(docs, make, f"{name} boolean", text).where(~F.col(name)).drop(name)
