"""Packing by power-of-two decomposition (operator 5).

A document's ids (its tokens, then the end id) are cut into pieces whose
lengths are powers of two: as many whole contexts as fit, then the binary
digits of the rest, longest first. A piece is a sequence of its own, and
sequences are bucketed by length, so none crosses documents or needs padding.
"""
from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.llm.common import in_slices, utf8

#: words, and words without case and closing marks, remembered per Python worker
REMEMBER = 500_000
#: longer words are encoded each time
LONGEST = 64
_MARKS = b".,!?;:#$%&*|"

_tokens: dict = {}  # per worker process, by tokenizer file


class WordTokens(dict):
    """Token ids of white-space separated words, as little-endian 32-bit bytes.

    For a tokenizer that drops white space, lower-cases and splits letters
    from punctuation: a text's ids are its words' ids in order, and a word of
    letters with marks behind it has the letters' ids, then the marks'. Words
    are remembered up to ``REMEMBER``; others are encoded when met.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cores: dict[str, bytes] = {}
        # byte-level vocabularies write a byte as a printable character: itself, or the next one from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.shown = {b: b if b in printable else next(other) for b in range(256)}
        probe = ["the", "straße", "élève", "über", "œuvre"]
        self.direct = all(self._model_ids(w) == self._encode(w.encode()) for w in probe)

    def _encode(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _model_ids(self, core: str) -> bytes:
        """Ids of lower-case letters that the normalizer and the splitter leave as they are."""
        shown = core if core.isascii() else core.encode().decode("latin-1").translate(self.shown)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _core(self, core: str) -> bytes:
        ids = self.cores.get(core)
        if ids is None:
            # letters up to U+017F have no combining forms here and lower-case one by one
            plain = self.direct and core.isalpha() and (core.isascii() or max(core) <= "\u017f" and "\u0130" not in core)
            ids = self._model_ids(core) if plain else self._encode(core.encode())
            if len(self.cores) >= REMEMBER:
                self.cores.clear()
            self.cores[core] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > LONGEST:
            return self._encode(word)
        raw = word.rstrip(_MARKS)
        core = raw.decode("utf-8", "replace")
        if core.isalpha():
            if core.isascii() or max(core) <= "\u017f" and "\u0130" not in core:
                core = core.lower()
            ids = self._core(core)
            if len(raw) < len(word):
                ids += self._core(word[len(raw):].decode())
        else:
            ids = self._encode(word)
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        """The ids of a text."""
        return b"".join(map(self.__getitem__, text.split()))


def _words_of(path: str) -> WordTokens:
    if path not in _tokens:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def pieces(length: int, context: int) -> list[tuple[int, int]]:
    """(start, length) of the binary pieces of ``length`` ids."""
    out = [(at, context) for at in range(0, length - length % context, context)]
    at, rest = length - length % context, length % context
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", context: int = 4096,
    end_id: int = 2, with_ids: bool = True,
) -> DataFrame:
    """Sequences of at most ``context`` ids (a power of two), a row per piece.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (always
    0: a sequence is one piece) and, ``with_ids``, the ids; ``length`` is the
    bucket. Null and empty texts are the end id alone. Repeated rows are
    packed each; an empty table gives no row. ``tokenizer`` is the file's path
    on the executors; it must drop white space.
    """
    if context & (context - 1) or context < 1:
        raise ValueError("context must be a power of two")
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, id_type)] + T._parse_datatype_string(
        "start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = _words_of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in in_slices(batch, "text", 1 << 20):
                rows, raws, which = [], [], []
                for i, text_ in enumerate(part.column("text")):
                    raw = words.of(text_.as_buffer().to_pybytes() if text_.is_valid else b"") + last
                    total = len(raw) // 4
                    for start, size in pieces(total, context):
                        own = raw[4 * start:4 * (start + size)]
                        rows.append((start, size, zlib.crc32(own), total))
                        which.append(i)
                        if with_ids:
                            raws.append(own)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                if with_ids:
                    sizes = np.cumsum([0, *(r[1] for r in rows)])
                    values = np.frombuffer(b"".join(raws), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(which, pa.int64())), *columns], names=schema.names)

    out = docs.select(F.col(doc_id).alias("id"), utf8(text).alias("text")).mapInArrow(run, schema)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder per length."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
