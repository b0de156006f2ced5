"""Secret scans: keyword automaton, anchored expressions, checksums (operator 4).

One Aho-Corasick pass over the ASCII-lower-cased bytes finds keywords; each
kind's expression is then matched only where its keyword stands. Hexadecimal
runs have no keyword and are found by their own run expression. Kinds that
carry a check value or a header of their own are kept only if it holds.
"""
from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from hashlib import sha256

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import map_documents
from keepwise.operators.joins import fresh

#: span kinds, in the order in which spans that start together are listed
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "slack", "stripe", "google")
BASE = KINDS[:3]

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_NPM = re.compile(rb"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
# up to the next five dashes, however far, without going back: linear in the text
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----([^-]*+(?:-(?!----)[^-]*+)*+)-----END \1-----")
_HEADER = re.compile(rb"[A-Za-z][A-Za-z0-9-]*:\s")
_SLACK = re.compile(rb"xox[abeprs]-(?:[0-9A-Za-z]{8,}-)+[0-9A-Za-z]{8,}")
_STRIPE = re.compile(rb"[rs]k_live_[0-9A-Za-z]{24,}")
_GOOGLE = re.compile(rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")

#: keyword (lower case) -> kind
KEYWORDS = {
    b"password": "assign", b"passwd": "assign", b"secret": "assign", b"token": "assign",
    b"apikey": "assign", b"api_key": "assign", b"akia": "access",
    b"ghp_": "github", b"gho_": "github", b"ghu_": "github", b"ghs_": "github", b"ghr_": "github",
    b"npm_": "npm", b"eyj": "jwt", b"-----begin ": "pem", b"xox": "slack", b"k_live_": "stripe", b"aiza": "google",
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: bytes) -> str:
    """Six base-62 digits of the CRC-32 of ``body`` (the check value of such tokens)."""
    value, out = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out


def _checked(m: re.Match) -> bool:
    return crc_base62(m[1][:30]).encode() == m[1][30:]


def _jwt_header(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


def _pem_body(m: re.Match) -> bool:
    """Whether a key stands between the marks: header lines, then base64 of what the label promises.

    Line ends may be escaped, as in JSON. An encrypted key tells only that it
    is whole cipher blocks; an armoured one ends with a check value of its own.
    """
    lines = m[2].replace(b"\\r", b"").replace(b"\\n", b"\n").split(b"\n")
    lines = [x.strip() for x in lines if x.strip()]
    headers = 0
    while headers < len(lines) and _HEADER.match(lines[headers]):
        headers += 1
    encrypted = any(x.startswith(b"Proc-Type:") and x.endswith(b"ENCRYPTED") for x in lines[:headers])
    armoured = m[1].endswith(b"BLOCK")
    body = lines[headers:]
    if armoured and body and body[-1].startswith(b"=") and len(body[-1]) == 5:
        if not _crc24(b"".join(body[:-1]), body[-1][1:]):
            return False
        body = body[:-1]
    try:
        raw = base64.b64decode(b"".join(b"".join(body).split()), validate=True)
    except binascii.Error:
        return False
    if armoured:
        return len(raw) > 2 and raw[0] & 0x80 > 0 and ((raw[0] & 0x3F) if raw[0] & 0x40 else (raw[0] >> 2 & 0xF)) in (5, 7)
    if encrypted:
        return len(raw) >= 16 and len(raw) % 8 == 0
    return len(raw) >= 30 and raw[:1] in (b"\x30", b"o")  # DER sequence, or "openssh"


def _crc24(body: bytes, check: bytes) -> bool:
    """Whether an armoured body has its check value."""
    try:
        data, want = base64.b64decode(body, validate=True), base64.b64decode(check, validate=True)
    except binascii.Error:
        return False
    crc = 0xB704CE
    for byte in data:
        crc ^= byte << 16
        for _ in range(8):
            crc = (crc << 1 ^ 0x1864CFB if crc & 0x800000 else crc << 1) & 0xFFFFFF
    return crc.to_bytes(3, "big") == want


#: kind -> (expression, start group of the secret itself, what must hold)
_RULES = {
    "assign": (_ASSIGN, 2, lambda m: len(m[2]) >= 6),
    "access": (_ACCESS, 0, lambda m: len(m[0]) >= 20),
    "github": (_GITHUB, 0, _checked),
    "npm": (_NPM, 0, _checked),
    "jwt": (_JWT, 0, _jwt_header),
    "pem": (_PEM, 0, _pem_body),
    "slack": (_SLACK, 0, bool),
    "stripe": (_STRIPE, 0, bool),
    "google": (_GOOGLE, 0, bool),
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word.decode("latin-1"), (len(word), kind))
    a.make_automaton()
    return a


def byte_spans(raw: bytes, keywords: ahocorasick.Automaton) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the secret itself) in bytes, sorted as listed."""
    near: dict[str, list[int]] = {}
    for end, (size, kind) in keywords.iter(raw.lower().decode("latin-1")):
        near.setdefault(kind, []).append(end + 1 - size)
    spans = [(m.start(), "hex", m.end(), m.start()) for m in _HEX.finditer(raw)]
    for kind, starts in near.items():
        expression, group, holds = _RULES[kind]
        done = 0
        for at in sorted(starts):
            at -= kind == "stripe"  # its keyword stands a letter into it
            if at >= done and (m := expression.match(raw, at)):
                done = m.end()
                if holds(m):
                    spans.append((m.start(), kind, m.end(), m.start(group)))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def _in_characters(raw: bytes, spans):
    """The spans with code points for byte offsets."""
    if raw.isascii() or not spans:
        return spans
    places = sorted({p for s in spans for p in (s[0], s[2], s[3])})
    at, count, to = 0, 0, {}
    for p in places:
        count += len(raw[at:p].decode("utf-8", "replace"))
        at = p
        to[p] = count
    return [(to[a], kind, to[b], to[c]) for a, kind, b, c in spans]


def _listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b, _ in spans)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with the secrets of each whole text.

    n_assign, n_access, n_hex count base spans; ``base_sha256`` digests them,
    ``spans`` lists all as kind:start:end (code points, end exclusive). Null
    and empty texts have none. Repeated rows each give a row.
    """
    def make():
        keywords = automaton()

        def one(raw: bytes) -> tuple:
            spans = _in_characters(raw, byte_spans(raw, keywords))
            base = [s for s in spans if s[1] in BASE]
            kinds = [s[1] for s in base]
            return (*(kinds.count(k) for k in BASE), sha256(_listed(base).encode()).hexdigest(), _listed(spans))

        return one

    return map_documents(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", text, keep)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` (of an assignment, its value).

    Overlapping secrets share one mark. Texts without secrets, null texts and
    all other columns are unchanged.
    """
    def make():
        keywords, sign = automaton(), mark.encode()

        def one(raw: bytes) -> tuple:
            spans = sorted((s[3], s[2]) for s in byte_spans(raw, keywords))
            if not spans:
                return (None,)
            out, at = [], 0
            for start, end in spans:
                if start >= at:
                    out += [raw[at:start], sign]
                at = max(at, end)
            return (b"".join([*out, raw[at:]]).decode("utf-8", "replace"),)

        return one

    name = fresh("__clean", docs.columns)
    clean = map_documents(docs, make, f"{name} string", text)
    return clean.withColumn(text, F.coalesce(name, text)).select(*docs.columns)
