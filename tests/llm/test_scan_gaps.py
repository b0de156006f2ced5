"""Nothing is lost to a look ahead, a cap or a clashing column."""
import base64
import random

import pytest
from pyspark.sql import functions as F

from keepwise.llm import licences, mixing, secret_scan, simhash, toxicity
from keepwise.llm.queries import held_out
from tests.conftest import SF001


def spans(text):
    return [(k, a, b) for a, k, b, _ in secret_scan.byte_spans(text.encode(), secret_scan.automaton())]


def wrapped(raw, width=64, end="\n"):
    text = base64.b64encode(raw).decode()
    return end.join(text[i:i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("text", [
    "-----BEGIN RSA PRIVATE KEY-----\n" + wrapped(b"\x30" + bytes(60_000)) + "\n-----END RSA PRIVATE KEY-----",
    "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n" + wrapped(bytes(range(160))) + "\n-----END RSA PRIVATE KEY-----",
    "-----BEGIN PRIVATE KEY-----\\n" + wrapped(b"\x30" + bytes(99), end="\\n") + "\\n-----END PRIVATE KEY-----",
    "-----BEGIN PRIVATE KEY-----\r\n" + wrapped(b"\x30" + bytes(99), end="\r\n") + "\r\n-----END PRIVATE KEY-----",
    "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: X\n\n" + wrapped(b"\x95" + bytes(200)) + "\n-----END PGP PRIVATE KEY BLOCK-----",
])
def test_private_keys(text):
    found = [s for s in spans("so: " + text + " end") if s[0] == "pem"]
    assert found == [("pem", 4, 4 + len(text.encode()))]


@pytest.mark.parametrize("text", [
    "-----BEGIN RSA PRIVATE KEY-----\nnot base64 at all!\n-----END RSA PRIVATE KEY-----",
    "-----BEGIN RSA PRIVATE KEY-----\n" + wrapped(b"\x30" + bytes(99)) + "\n-----END EC PRIVATE KEY-----",
    "-----BEGIN PUBLIC KEY-----\n" + wrapped(b"\x30" + bytes(99)) + "\n-----END PUBLIC KEY-----",
    "-----BEGIN PGP PRIVATE KEY BLOCK-----\n\n" + wrapped(b"\x95" + bytes(200)) + "\n=AAAA\n-----END PGP PRIVATE KEY BLOCK-----",
    "-----BEGIN PRIVATE KEY-----" * 3000,
])
def test_no_private_keys(text):
    assert not [s for s in spans(text) if s[0] == "pem"]


def test_further_kinds():
    # put together here, so that no scanner takes this file for a leak
    slack, stripe, google = "xoxb-" + "1" * 12 + "-" + "a1" * 12, "sk_" + "live_" + "4eC39H" * 5, "AIza" + "Sy" * 17 + "d"
    for kind, text in (("slack", slack), ("stripe", stripe), ("google", google)):
        assert (kind, 2, 2 + len(text)) in spans("x " + text + " y")


NAMES = sorted(licences.NAMES)


def notice(rng):
    subject = rng.choice(["", "The project is ", "This work is ", "Foo Tools are ", "the code is dual "])
    verb = rng.choice(["licensed", "released", "available", "provided", "covered", "made available", "thrown"])
    return f"{subject}{verb} under {rng.choice(['', 'the ', 'the terms of the '])}{rng.choice([*NAMES, 'snow', 'a roof'])}{rng.choice(['', ', see LICENSE'])}."


def test_the_look_ahead_loses_nothing():
    rng, r, found = random.Random(2), licences.Recogniser(), 0
    more = ["SPDX-License-Identifier: MIT", "Bar is free software: you can redistribute it", "Unrelated words, and no licence.", ""]
    for _ in range(3000):
        raw = " ".join(rng.choice([notice(rng), *more, *licences.SENTENCES]) for _ in range(rng.choice([1, 1, 2]))).encode()
        assert r.ids(raw) == r.read(raw)
        found += bool(r.ids(raw))
    assert found > 1000
    for name in licences.NAMES:
        assert r.ids(f"It is available under {name}.".encode()) == [licences.NAMES[name]]


@pytest.mark.parametrize("text, want", [
    ("The project is available under MIT.", ["MIT"]),
    ("Provided under CC BY 4.0.", ["CC-BY-4.0"]),
    ("# SPDX-License-Identifier: MIT\nimport os", ["MIT"]),
    ("// SPDX-License-Identifier: GPL-3.0-or-later\n", ["GPL-3.0-or-later"]),
    ("Licensed under Apache-2.0.", ["Apache-2.0"]),
    ("Foo is released under the GPLv3.", ["GPL-3.0-only"]),
    ("Foo is released under GPLv2 or later.", ["GPL-2.0-or-later"]),
])
def test_usual_spellings(text, want):
    r = licences.Recogniser()
    assert r.match(r.ids(text.encode()))[0] == want


CLASHES = ("__id", "__fp", "__own", "__n", "__toxic", "__clean", "__copy", "__text", "fp", "root", "score", "times")


def test_columns_named_like_internal_ones_come_through(spark, odd):
    docs = odd
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(f"mine{i}"))
    model = toxicity.fit(spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/labels.parquet"), held_out=held_out())
    for after in (toxicity.reject(docs, model), simhash.one_of_each(docs), secret_scan.redact(docs), mixing.repeat(docs)):
        rows = after.select(*CLASHES).distinct().collect()
        assert after.columns == docs.columns
        assert [tuple(r) for r in rows] == [tuple(f"mine{i}" for i in range(len(CLASHES)))]


def test_of_equal_documents_the_smallest_row_stays(spark):
    rows = [(1, "a b c d e f", "en", x) for x in ("z", "k", "m", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for n in (1, 3):
        assert [r["source"] for r in simhash.one_of_each(df.repartition(n)).collect()] == [None]
        assert [r["source"] for r in simhash.one_of_each(df.where("source IS NOT NULL").repartition(n)).collect()] == ["k"]
