"""Quality rules learned as a decision list (operator 3).

Statistics of each whole text are compared with labels. Sequential covering
grows one conjunction of thresholds at a time on two thirds of the labelled
rows, prunes it on the others, removes the rows it covers and goes on; the
list becomes one ordered Spark conditional expression.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import map_documents

_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))  # white space, UTF-8 continuation
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
WINDOW = 8

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "n_lines long, n_distinct long, n_upper long, n_digits long, n_marks long, n_chars_all long, n_run_words long")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words found twice or more in the text.

    Windows are compared exactly: ids of words, then of pairs, then of pairs
    of pairs, by sorting.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size, kinds = 1, len(seen)
    while True:
        if kinds == len(ids):
            return 0  # all windows of this size differ, so all longer ones do
        if size == window:
            break
        step = min(size, window - size)
        pair = ids[:-step] * kinds + ids[step:]
        size += step
        values, ids = np.unique(pair, return_inverse=True)
        kinds = len(values)
    often = np.bincount(ids, minlength=kinds)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def text_stats(raw: bytes) -> tuple:
    """The values of ``STATS`` of one text."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    run = sum(a == b for a, b in zip(words, words[1:]))
    size = len(raw)
    return (
        len(words), len(raw.translate(None, _NOT_COUNTED)), size - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)),
        size - len(raw.translate(None, _UPPER)), size - len(raw.translate(None, _DIGIT)),
        raw.count(b"!"), len(raw.translate(None, _NOT_COUNTED[6:])), run,
    )


def with_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with the statistics of each whole text (null: all zero)."""
    return map_documents(docs, lambda: lambda raw: text_stats(raw), STATS, text, keep)


def features() -> dict[str, Column]:
    """What rules compare: counts, and shares of the text's words, lines or characters."""
    c = F.col

    def share(a: str, b: str) -> Column:
        return F.coalesce(c(a) / F.nullif(c(b), F.lit(0)), F.lit(0.0))

    return {
        "words": c("n_words").cast("double"), "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"), "run_share": share("n_run_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, ">" or "<=", threshold)."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, cut in self.tests:
            out = out & (columns[name] > cut if sign == ">" else columns[name] <= cut)
        return out

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, cut in self.tests:
            out &= x[name] > cut if sign == ">" else x[name] <= cut
        return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, cuts: dict[str, np.ndarray], longest: int) -> Rule:
    """Adds the test of the highest information gain until no good row is covered."""
    rule, inside = Rule(()), np.ones(len(y), bool)
    while len(rule.tests) < longest:
        p, n = (y & inside).sum(), (~y & inside).sum()
        if not p or not n:
            break
        before, best, test = np.log2(p / (p + n)), 1e-9, None
        for name in sorted(x):
            at = np.searchsorted(cuts[name], x[name][inside], "left")  # value <= cuts[k] for k >= at
            size = len(cuts[name]) + 1
            low_p = np.cumsum(np.bincount(at[y[inside]], minlength=size))[:-1]
            low_n = np.cumsum(np.bincount(at[~y[inside]], minlength=size))[:-1]
            for sign, a, b in (("<=", low_p, low_n), (">", p - low_p, n - low_n)):
                if not len(a):
                    continue
                gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1e-9) / np.maximum(a + b, 1)) - before), 0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, test = gain[k], (name, sign, float(cuts[name][k]))
        if test is None:
            break
        rule = Rule((*rule.tests, test))
        inside = rule.covers(x)
    return rule


def learn(
    x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7, min_precision: float = 0.9,
    min_covered: int = 5, longest: int = 4, n_cuts: int = 64, most_rules: int = 16,
) -> list[Rule]:
    """An ordered list of rules for bad rows; empty without bad or without good rows."""
    x, bad, rules = dict(x), np.asarray(bad, bool), []
    rng = np.random.default_rng(seed)
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, n_cuts), method="inverted_cdf")) if len(v) else v for k, v in x.items()}
    while len(rules) < most_rules and bad.sum() >= min_covered and not bad.all():
        grows = rng.random(len(bad)) < 2 / 3
        rule = _grow({k: v[grows] for k, v in x.items()}, bad[grows], cuts, longest)
        held, bad_held = {k: v[~grows] for k, v in x.items()}, bad[~grows]

        def worth(r: Rule) -> float:
            inside = r.covers(held)
            p, n = (bad_held & inside).sum(), (~bad_held & inside).sum()
            return (p - n) / (p + n) if p + n else -1.0

        choices = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
        if not choices:
            break
        rule = max(choices, key=worth)  # the shortest on ties
        inside = rule.covers(x)
        covered, right = inside.sum(), (bad & inside).sum()
        inside_held = rule.covers(held)
        if covered < min_covered or right < min_precision * covered or (bad_held & inside_held).sum() < min_precision * inside_held.sum():
            break
        rules.append(rule)
        x, bad = {k: v[~inside] for k, v in x.items()}, bad[~inside]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects."""
    columns, out = features(), None
    for rule in rules:
        out = (F if out is None else out).when(rule.column(columns), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", max_rows: int = 20_000, **options) -> list[Rule]:
    """Rules for ``label`` 0, from the ``max_rows`` labelled ids of smallest hash at most.

    ``max_rows`` bounds what the learner holds; it bounds labels before the
    join, so repeated documents of one id may add rows (a row each value).
    """
    names = list(features())
    some = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("__label")) \
        .orderBy(F.xxhash64(doc_id), doc_id).limit(max_rows)
    rows = stats.join(F.broadcast(some), doc_id).groupBy(doc_id).agg(
        F.min(F.struct(F.col("__label").alias("label"), *[v.alias(k) for k, v in features().items()])).alias("r"))
    table = rows.select("r.*", F.xxhash64(doc_id).alias("h")).toPandas().sort_values(["h", *names]).reset_index(drop=True)
    return learn({k: table[k].to_numpy(float) for k in names}, (table["label"] == 0).to_numpy(bool), **options)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with base_failed (fixed limits) and kept (the list's verdict on the others)."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
