"""Chat formatting: exact round trips, typed parts, the loss mask."""
import random
import re

import pytest
from pyspark.sql import functions as F

from keepwise.llm import chat
from keepwise.llm.queries import op12_chat_format
from tests.conftest import SF001

ROW = "conv_id long, turn long, role string, text string"
PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def plain(df):
    return df.select("conv_id", "turn", "role", chat.text_part("text").alias("parts"))


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def read(formatted):
    return formatted.select("*", chat.read_turns(F.col("formatted")).alias("turns"),
                            chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))


def test_round_trip_of_control_strings(spark):
    rng = random.Random(4)
    bits = [*chat.Template().controls(), "\\", "\\\\", "<", "[", "s>", "|turn|>", "</s", "\n", "é", " ", "日本", "<\\s>", "x"]
    rows = [(c, t, rng.choice(["user", "assistant", "<|end|>", "system"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))))
            for c in range(40) for t in range(rng.randint(1, 9))]
    made = chat.format_chats(plain(spark.createDataFrame(rows, ROW)))
    for r in read(made).collect():
        own = sorted(x[1:] for x in rows if x[0] == r["conv_id"])
        assert [(t["role"], "".join(p["text"] for p in t["parts"])) for t in r["turns"]] == [(role, text) for _, role, text in own]
        assert r["learned"] == "".join(text for _, role, text in own if role == "assistant")
        assert r["formatted_chars"] == len(r["formatted"])
        for s in r["loss_spans"]:
            assert r["formatted"].encode()[s["first_byte"]:s["end_byte"]].decode() == r["formatted"][s["start"]:s["end"]]
        marks = re.findall(r"<\|(?:turn|text|end)\|>", r["formatted"])
        assert marks == ["<|turn|>", "<|text|>", "<|end|>"] * len(own)
        for foreign in chat.Template().foreign:
            assert foreign not in r["formatted"]


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [part("text", "see <|image|> "), part("image", ref="a.png", width=56, height=29), part("text", " and "),
                        part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=3)]),
        (1, 1, "assistant", [part("text", "here:"), part("image", ref="d.png"), part("text", "done")]),
        (2, 0, "user", None),
        (2, 1, "assistant", []),
        (2, 2, "tool", [part(None, "of no type"), part("odd", "of an odd type"), part("image"), part("audio"), part("document")]),
    ]
    one, two = read(chat.format_chats(spark.createDataFrame(rows, PARTS))).orderBy("conv_id").collect()
    assert one["formatted"] == ("<|turn|>user<|text|>see <\\|image|> <|image|> and <|audio|><|document|><|end|>"
                                "<|turn|>assistant<|text|>here:<|image|>done<|end|>")
    assert [tuple(a) for a in one["attachments"]] == [
        (1, "image", "a.png", 2 * 2), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 3 * 1024), (4, "image", "d.png", 1)]
    assert one["expanded_tokens"] == 4 + 38 + 3072 + 1
    assert one["learned"] == "here:done" and len(one["loss_spans"]) == 2
    assert [(p["type"], p["text"]) for p in one["turns"][0]["parts"]] == [
        ("text", "see <|image|> "), ("image", None), ("text", " and "), ("audio", None), ("document", None)]
    assert [tuple(a) for a in two["attachments"]] == [(1, "image", None, 1), (2, "audio", None, 1), (3, "document", None, 1024)]
    assert [t["role"] for t in two["turns"]] == ["user", "assistant", "tool"] and two["learned"] == ""
    assert two["turns"][2]["parts"][0]["text"] == "of no typeof an odd type"


def test_another_visitor(spark):
    class Short(chat.Visitor):
        def document(self, part):
            return F.lit(self.template.media["document"]), F.lit(7)

    rows = spark.createDataFrame([(1, 0, "user", [part("document", ref="x")])], PARTS)
    assert chat.format_chats(rows, visitor=Short()).first()["expanded_tokens"] == 7
    with pytest.raises(ValueError):
        chat.Template(turn="<a<")


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (1, 2, "assistant", ""),
            (None, 0, "assistant", "lost"), (None, 1, "assistant", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], ROW + ", place int, flat int, chars int")
    df = df.select("*", chat.text_part("text").alias("parts"))
    nobody, one = read(chat.format_chats(df)).orderBy(F.col("conv_id").asc_nulls_first()).collect()
    assert [(t["role"], "".join(p["text"] for p in t["parts"])) for t in one["turns"]] == [
        ("", ""), ("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert nobody["learned"] == "lost" + "x" * 200_000 and one["learned"] == "" and one["loss_spans"] == []
    assert chat.format_chats(df.where("conv_id = 99")).count() == 0


def test_plan_is_native(spark):
    plan = op12_chat_format(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|RDD", plan)


def test_query_reads_back_the_planted_conversation(spark):
    import hashlib

    row = op12_chat_format(spark, SF001).where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said)
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row["formatted_chars"] > 2 * len(said)
