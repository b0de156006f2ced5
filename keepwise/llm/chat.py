"""Chat formatting over typed content parts (operator 12), in DataFrame functions only.

A turn is a list of parts: text, image, audio or document. A visitor with a
method per type flattens them in order: text is escaped, every other part
becomes its placeholder, and what the placeholder stands for (reference, kind,
tokens after expansion) is recorded beside the conversation. The template marks
turns; no control string inside a text survives as one, and the escape can be
undone exactly.

A conversation's formatted text is one value, so its turns meet in one task,
where windows and one collected list put its parts together in time that grows
with its length.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: a content part; each type uses the fields it needs
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
MEDIA = ("image", "audio", "document")


@dataclass(frozen=True)
class Template:
    """Marks of the formatted text, and the strings that a text must not hold as such.

    All start with a character that occurs in none of them again and hold no
    backslash, so one regular expression finds each occurrence.
    """
    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    media: dict[str, str] = field(default_factory=lambda: {m: f"<|{m}|>" for m in MEDIA})
    #: control strings of usual tokenizers, which may become one special token
    foreign: tuple[str, ...] = ("<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def __post_init__(self):
        openers = {c[0] for c in self.controls()}
        if any(x in openers or x == "\\" for c in self.controls() for x in c[1:]):
            raise ValueError("a control string holds a backslash, or the first character of one, after its first")

    def controls(self) -> list[str]:
        return [self.turn, self.body, self.end, *self.media.values(), *self.foreign]

    def _pattern(self, after: str) -> str:
        openers = "".join(sorted({re.escape(c[0]) for c in self.controls()}))
        rests = "|".join(sorted({re.escape(c[1:]) for c in self.controls()}))
        return rf"([{openers}]){after}(?={rests})"

    def escape(self, text: Column) -> Column:
        """A backslash more after the first character of each control string, escaped ones included."""
        return F.regexp_replace(text, self._pattern(r"(\\*+)"), r"$1$2\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\(\\*+)"), "$1$2")


@dataclass(frozen=True)
class Visitor:
    """What each type of part becomes: its flat text, and the tokens it expands to.

    A method takes the part as a struct column. Subclass it for other sizes.
    """
    template: Template = Template()
    patch: int = 28  # pixels along an image token
    per_second: float = 25.0  # audio tokens
    per_page: int = 1024  # document tokens

    def text(self, part: Column) -> tuple[Column, Column]:
        return self.template.escape(F.coalesce(part["text"], F.lit(""))), F.lit(None)

    def image(self, part: Column) -> tuple[Column, Column]:
        side = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)) / F.lit(float(self.patch)))
        return F.lit(self.template.media["image"]), side(part["width"]) * side(part["height"])

    def audio(self, part: Column) -> tuple[Column, Column]:
        seconds = F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0))
        return F.lit(self.template.media["audio"]), F.greatest(F.ceil(seconds * F.lit(self.per_second)), F.lit(1))

    def document(self, part: Column) -> tuple[Column, Column]:
        pages = F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(1))
        return F.lit(self.template.media["document"]), pages * F.lit(self.per_page)

    def visit(self, part: Column) -> Column:
        """struct(kind, flat, ref, tokens); a part of no known type is text."""
        def made(kind: str) -> Column:
            flat, tokens = getattr(self, kind)(part)
            ref = F.lit(None) if kind == "text" else part["ref"]
            return F.struct(F.lit(kind).alias("kind"), flat.alias("flat"), ref.cast("string").alias("ref"),
                            tokens.cast("long").alias("tokens"))

        out = made("text")
        for kind in MEDIA:
            out = F.when(part["type"] == kind, made(kind)).otherwise(out)
        return out


def text_part(text: str | Column) -> Column:
    """A turn of plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), (F.col(text) if isinstance(text, str) else text).alias("text"),
                            *[F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")]).cast(PART))


def format_chats(rows: DataFrame, parts: str = "parts", conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 visitor: Visitor = Visitor(), learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per conversation from a row per turn.

    conv_id, formatted, formatted_chars, loss_spans (text parts of ``learned``
    roles: start and end in code points, first_byte and end_byte in UTF-8),
    attachments (ordinal of the placeholder from 1, kind, ref, tokens) and
    expanded_tokens (of all placeholders).

    Turns go by number (null first), equal numbers by role, then parts; equal
    rows are turns of their own. Null texts, roles and lists of parts are
    empty; turns with a null id are one conversation. Other columns of
    ``rows`` don't matter; an empty table gives no row.
    """
    t = visitor.template
    part = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    rows = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                       F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), part.alias("parts"))
    mark = lambda kind, flat: F.struct(
        F.lit(kind).alias("kind"), flat.alias("flat"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
    opened = mark("open", F.concat(F.lit(t.turn), t.escape(F.col("role")), F.lit(t.body)))
    pieces = F.concat(F.array(opened), F.transform("parts", visitor.visit), F.array(mark("end", F.lit(t.end))))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "parts")))
    flat = numbered.select("conv_id", "place", F.col("role").isin(*learned).alias("learned"), F.posexplode(pieces).alias("at", "piece"))
    flat = flat.select("conv_id", "place", "at", "learned", "piece.*").withColumns(
        {"chars": F.char_length("flat").cast("long"), "bytes": F.octet_length("flat").cast("long")})
    upto = Window.partitionBy("conv_id").orderBy("place", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flat = flat.withColumns({"end": F.sum("chars").over(upto), "end_byte": F.sum("bytes").over(upto)})
    where = [F.col("place"), F.col("at")]
    span = F.struct(*where, (F.col("end") - F.col("chars")).alias("start"), "end",
                    (F.col("end_byte") - F.col("bytes")).alias("first_byte"), "end_byte")
    whole = flat.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(*where, "flat"))).alias("flats"),
        F.array_sort(F.collect_list(F.when(F.col("learned") & (F.col("kind") == "text") & (F.col("chars") > 0), span))).alias("spans"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin(*MEDIA), F.struct(*where, "kind", "ref", "tokens")))).alias("media"),
        F.max("end").alias("formatted_chars"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("expanded_tokens"))
    return whole.select(
        "conv_id", F.array_join(F.transform("flats", lambda x: x["flat"]), "").alias("formatted"), "formatted_chars",
        F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["first_byte"], x["end_byte"])).alias("loss_spans"),
        F.transform("media", lambda x, i: F.struct((i + 1).alias("ordinal"), x["kind"], x["ref"], x["tokens"])).alias("attachments"),
        "expanded_tokens")


def read_parts(body: Column, template: Template = Template()) -> Column:
    """The parts of a formatted turn: struct(type, text), text unescaped and null for placeholders."""
    marks = {kind: re.escape(m) for kind, m in template.media.items()}
    cut = "|".join([f"(?={m})|(?<={m})" for m in marks.values()])

    def part(x: Column) -> Column:
        kind = F.coalesce(*[F.when(x == m, F.lit(k)) for k, m in template.media.items()], F.lit("text"))
        return F.struct(kind.alias("type"), F.when(kind == "text", template.unescape(x)).alias("text"))

    return F.transform(F.filter(F.split(body, cut), lambda x: x != ""), part)


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: struct(role, parts), in order."""
    def turn(x: Column) -> Column:
        role = F.substring_index(x, template.body, 1)
        start = F.char_length(role) + len(template.body)
        body = F.substring(x, start + 1, F.char_length(x) - start - len(template.end))
        return F.struct(template.unescape(role).alias("role"), read_parts(body, template).alias("parts"))

    # what stands before the first mark is empty
    return F.transform(F.filter(F.split(formatted, re.escape(template.turn)), lambda x: x != ""), turn)


def text_of(parts: Column) -> Column:
    """The text of a turn that was read back, its parts joined."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")


def masked_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    Spans are cut from the bytes: code points would be counted from the start
    of the text for each.
    """
    cut = lambda b: F.transform(spans, lambda s: template.unescape(
        F.substring(b, (s["first_byte"] + 1).cast("int"), (s["end_byte"] - s["first_byte"]).cast("int")).cast("string")))
    return F.array_join(F.transform(F.array(formatted.cast("binary")), cut)[0], "")
