"""Formatted conversations read back to what they were, and equal their SQL."""

import pytest

from emberline.llm import chat
from fixtures.compare import connect, difference

SCHEMA = "conv_id long, turn long, role string, text string, turns int"


def test_round_trip_of_conflicting_texts(frame):
    texts = ["", "<", "|", "<|", "<\\|", "<\\\\|", "\\<|", "<<||", chat.START, chat.END, chat.END + "\n" + chat.START + "user\nx", chat.TRICKY, "a<|im_end|>\n", "$1 \\1 <$1|", "é😀\r\n", "x" * 100_000, "<" * 5000, None]
    rows = [(i, 0, role, text, 1) for i, text in enumerate(texts) for role in ["assistant"]]
    rows += [(1000, i, role, "t", 1) for i, role in enumerate(["us er", "a\nb", "a+b%2B", "", None, "<|im_end|>", "é"])]
    got = chat.masked(chat.formatted(frame(rows, SCHEMA))).collect()
    assert all(x["faithful"] for x in got)
    for x in got:
        if x["conv_id"] < 1000:
            assert [(t["text"], t["trained"]) for t in x["turns"]] == [(texts[x["conv_id"]] or "", True)]
            body = x["formatted"].removeprefix(chat.START + "assistant\n").removesuffix(chat.END + "\n")
            assert "<|" not in body
        else:
            assert [t["role"] for t in x["turns"]] == ["us er", "a\nb", "a+b%2B", "", "", "<|im_end|>", "é"]


def test_texts_without_conflict_stay_as_they_are(frame):
    got = chat.formatted(frame([(1, 1, "assistant", "b \\ c", 0), (1, 0, "user", "a < b | c", 0)], SCHEMA)).collect()
    assert got[0]["formatted"] == "<|im_start|>user\na < b | c<|im_end|>\n<|im_start|>assistant\nb \\ c<|im_end|>\n"


def test_order_of_ties_nulls_and_repeated_rows(frame):
    rows = [(1, 2, "user", "b", 0), (1, 2, "user", "a", 0), (1, None, "user", "z", 0), (1, 2, "user", "a", 0), (None, 1, "user", "n", 0)]
    got = {x["conv_id"]: [t["text"] for t in x["turns"]] for x in chat.masked(chat.formatted(frame(rows, SCHEMA))).collect()}
    assert got == {1: ["z", "a", "a", "b"], None: ["n"]}


def test_equals_sql(spark, sf):
    from emberline.llm import queries

    assert difference(queries.op8_chat(spark, sf), connect(sf), chat.ORACLE) is None


def test_no_python_in_the_plan(spark, sf):
    from emberline.llm import queries

    plan = queries.op8_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_empty_table(frame):
    assert chat.digests(chat.formatted(frame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("text", ["<|", "a<\\|b<|", "plain"])
def test_escapes_reverse(spark, text):
    from pyspark.sql import functions as F

    row = spark.range(1).select(chat.escape(F.lit(text)).alias("a"), chat.unescape(chat.escape(F.lit(text))).alias("b")).first()
    assert "<|" not in row["a"] and row["b"] == text


@pytest.mark.parametrize("role", ["assistant\n", "\nassistant", "assistant\r", "assistant ", "a%20b", "<|im_start|>", "é\u2028"])
def test_roles_that_end_in_white_space_read_back(frame, role):
    rows = frame([(1, 0, role, "hi"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    out = chat.formatted(rows)
    read = chat.masked(out).first()
    assert read["faithful"] and [(t["role"], t["text"]) for t in read["turns"]] == [(role, "hi"), ("assistant", "yes")]
    assert chat.digests(out).first()["loss_chars"] == 3
