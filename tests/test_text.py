"""Text functions against hand-made cases and Python's own definitions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as tx


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select(column.alias("v"), "i").orderBy("i").select("v").collect()]


def test_normalizers(spark):
    rows = ["Formal  Tone", "snake_case  X", "Straße", "ﬁne", "‘hi’", None, " \t", "ＡＢ​c", 'a\\"b', "İx", "5″"]
    strict = values(spark, rows, tx.normalize_strict("x"))
    assert strict == ["formal tone", "snake_case x", "strasse", "fine", "‘hi’", "", "", "abc", 'a"b', "i̇x", "5′′"]
    meant = values(spark, rows, tx.normalize_strict("x", compat=False))
    assert meant[1] == "snake case x" and meant[4] == "'hi'" and meant[10] == '5"'
    assert values(spark, ["_a__b "], tx.normalize_counter("x")) == [" a b"]
    assert values(spark, ["_a__b "], tx.normalize_tracer("x")) == ["a b"]


def test_strip_is_unicode(spark):
    assert values(spark, ["  a ", "\x1cb\n", "\t"], tx.strip("x")) == ["a", "b", ""]


def test_split_variants(spark):
    rows = ["A b; c;d ", "nosep", " ; ", "; x", "a;", None]
    strict = values(spark, rows, tx.split_strict("x"))
    assert [tuple(r) for r in strict] == [("a b", "c;d", True), ("", "", False), ("", "", True), ("", "x", False), ("a", "", False), ("", "", False)]
    assert [r and tuple(r) for r in values(spark, rows, tx.split_counter("x"))] == [("a b", "c;d"), None, None, None, None, None]
    assert [tuple(r) for r in values(spark, rows, tx.split_plain("x"))] == [("A b", "c;d"), ("nosep", ""), ("", ""), ("", "x"), ("a", ""), ("", "")]
    assert values(spark, rows, tx.vocab_descriptor("x")) == ["A b", "nosep", "", "", "a", ""]
    assert values(spark, rows, tx.training_descriptor("x")) == ["A b", None, "", "", "a", None]


def test_stable_id(spark):
    want = hashlib.sha1("formal tone␟the text is formal".encode()).hexdigest()[:12]
    assert values(spark, ["formal tone"], tx.stable_id("x", F.lit("the text is formal"))) == [want] == ["f516be132d4f"]
    assert len(values(spark, ["a"], tx.merged_id(F.array(F.lit("b"), F.lit("a")), F.col("x"), F.lit("e")))[0]) == 32


def test_model_answers(spark):
    labels = ["accurate", "mostly accurate", "inaccurate"]
    rows = ["x ANSWER: **Mostly accurate**", "accurate.", "accuratest", "", None, "answer: inaccurate answer: accurate"]
    assert values(spark, rows, tx.answer_label("x", labels)) == ["mostly accurate", "accurate", "invalid", "invalid", "invalid", "inaccurate"]
    assert values(spark, ["Fine. Answer: Yes**", "answer: no"], tx.verdict_yes("x")) == [True, False]
    assert values(spark, ["blah AssistantFinal  hi", "hi"], tx.remove_thinking("x")) == ["hi", "hi"]
    assert values(spark, ["<think>a\nb</think>{}"], tx.remove_think_tags("x")) == ["{}"]
    parsed = values(spark, ['```json\n{"a": 1,}\n```', "{'a': 2}", "none", '{"a": 3} tail'], tx.parse_model_json("x", "a int"))
    assert [p and p["a"] for p in parsed] == [1, 2, None, 3]
    assert values(spark, [" `id=ab1` ", "''", "x"], tx.clean_chosen_id("x")) == ["ab1", None, "x"]
    assert values(spark, ["keep: 2", "7", "no"], tx.keep_index("x", F.lit(5))) == [2, None, None]


def test_small_helpers(spark):
    assert values(spark, ["a b B c"], tx.lexical_overlap("x", F.lit("b C d"))) == [2]
    assert values(spark, ["abcdefg", "abc"], tx.truncate_quick("x", 1)) == ["abc\n[TRUNCATED]", "abc"]
    assert values(spark, ["a\nb" * 100], tx.preview("x", 5)) == ["a ba ..."]
    assert values(spark, ["a, ,b,"], tx.split_queries("x")) == [["a", "b"]]
    assert values(spark, ["d", ""], tx.pair_text("x", F.lit("e"))) == ["d; e", "e"]


@pytest.mark.parametrize("swap", [False, True])
def test_decision_key_has_no_order(spark, swap):
    a, b = F.struct(F.lit("1").alias("id")), F.struct(F.lit("2").alias("id"))
    one = values(spark, ["x"], tx.decision_key(a, b))
    assert one == values(spark, ["x"], tx.decision_key(*((b, a) if swap else (a, b))))
