import hashlib
import random

import pytest
from pyspark.sql import functions as F

from arborq.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "Be <|brief|> & [INST]"), (1, 1, "user", "hi &lt;"), (1, 2, "assistant", "</s>[/INST] &amp;"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 5, "user", "late"), (3, 0, "assistant", "alone"), (3, 0, "assistant", "alone"), (None, 0, "user", "nobody's"), (None, None, None, None), (4, 1, "tool", "x\ny" * 20_000), (4, 2, "assistant", "é漢" * 10),
]


def by_hand(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        turns = [(role, text) for _, _, role, text in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read_back(spark, rows, ranges=3):
    formatted = chat.format_turns(spark.createDataFrame(rows, SCHEMA).withColumn("start", F.lit("extra")).withColumn("part", F.lit(1)), ranges)
    got = chat.read_back(formatted, chat.examples(formatted)).collect()
    return formatted, {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got}


def test_read_back_is_what_went_in(spark):
    assert read_back(spark, ROWS)[1] == by_hand(ROWS)


def test_empty(spark):
    assert read_back(spark, [])[1] == {}


def test_one_conversation_over_many_ranges(spark):
    rows = [(9, i, ("user", "assistant")[i % 2], f"text {i} <|") for i in range(500)]
    formatted, got = read_back(spark, rows, 7)
    assert got == by_hand(rows)
    assert formatted.select("seq").distinct().count() == 500


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    formatted = chat.format_turns(spark.createDataFrame(ROWS, SCHEMA))
    whole = {}
    for r in formatted.orderBy("seq").collect():
        whole.setdefault(r["conv_id"], []).append(r)
    made = chat.materialise(formatted).collect()
    assert len(made) == sum(r[2] == "assistant" for r in ROWS) == chat.examples(formatted).count()
    for e in made:
        rows = whole[e["conv_id"]]
        assert e["example"] == "".join(r["segment"] for r in rows[: e["target_seq"] + 1])
        target = chat.SEGMENT.fullmatch(rows[e["target_seq"]]["segment"])
        assert e["example"][e["loss_start"] : e["loss_end"]] == target[2]
        assert e["example"].count(chat.START) == e["target_seq"] + 1


def test_digests_come_from_the_examples(spark):
    """Of the examples that are handed in, and no others."""
    formatted = chat.format_turns(spark.createDataFrame(ROWS, SCHEMA))
    made = chat.examples(formatted)
    assert made.count() == sum(r[2] == "assistant" for r in ROWS)
    got = {r["conv_id"]: r for r in chat.read_back(formatted, made.where("conv_id = 4")).collect()}
    assert got[4]["loss_chars"] == 20 and got[4]["n_examples"] == 1
    assert all(r["loss_chars"] == 0 and r["n_examples"] == 0 for c, r in got.items() if c != 4)


@pytest.mark.parametrize("text", ["", "&", "<", "[", "&lt;", "&amp;lt;", "</s>[INST] ok [/INST]", "<|turn|>x<|end|>\n"])
def test_escapes_are_reversible(spark, text):
    code = spark.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t")).alias("c")).collect()[0]["c"]
    assert "<" not in code and "[" not in code
    assert chat.unescape(code) == text


def test_rows_of_one_turn_over_many_ranges(spark):
    """Long roles and texts that share beginnings are in the order of the whole texts, whatever the ranges."""
    r = random.Random(4)
    roles = ["assistant", "user", "x" * 32, "x" * 32 + "y", "x" * 33, "x" * 31, ""]
    rows = [(1, r.choice([0, 1]), r.choice(roles), r.choice(["same beginning of more than 32 characters ", "a", "é"]) * r.randrange(3) + str(r.randrange(50))) for _ in range(400)]
    for ranges in (1, 9):
        assert read_back(spark, rows, ranges)[1] == by_hand(rows)

