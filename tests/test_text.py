import re
import warnings

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import fixed, text
from lexiloom.operators import dialogue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


ALL_CLASSES = "A①⑳b⑴⒇㈠㈩⒈⒓*{}§︴-—_【】○�；X※𠀀é"


def test_all_pattern_classes(spark):
    cleaned = text.split_semicolons(text.clean_text(F.lit(ALL_CLASSES)))
    assert one(spark, cleaned) == "A\nX※𠀀é"
    assert one(spark, text.clean_text(F.lit("A※B"), fixed.EXTRA_PATTERNS)) == "AB"
    assert one(spark, text.clean_text(F.lit("Abc-12"))) == "A12"
    assert one(spark, text.clean_text(F.lit("same"), ())) == "same"


def test_fused_list_equals_the_list_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one_by_one = F.col("text")
    for p in fixed.OCR_PATTERNS:
        one_by_one = F.regexp_replace(one_by_one, p, "")
    assert docs.where(text.clean_text("text") != one_by_one).count() == 0


def test_classes_with_hyphens_at_the_edge(spark):
    assert one(spark, text.clean_text(F.lit("a-bcz hello-x"), ("[a-]", "z"))) == "bc hellox"
    assert one(spark, text.clean_text(F.lit("ab-c a-"), ("b", "[-z]"))) == "ac a"
    assert one(spark, text.clean_text(F.lit("第１２章 é_中"), (r"\d+", r"\w\b"))) == re.sub(
        r"\w\b", "", re.sub(r"\d+", "", "第１２章 é_中"))


_CLASS_PARTS = ["a-", "-z", "a-c", "&&", "&", "^b", "b^", "]a", "x[y", "é", r"\d", r"\]", "_", "0-9-"]
_PATTERNS = st.one_of(
    st.lists(st.sampled_from(_CLASS_PARTS), min_size=1, max_size=2).map(lambda p: f"[{''.join(p)}]"),
    st.sampled_from(["a", "-", "&", "z", r"\*", r"\-", "é", r"\d+", r"\w\b", "ab", "1|2", "[^a-z]", "b+"]))


_DIALECT = [
    "a.b", "x$", "^a", "end\\Z", r"\Aa", "(?P<q_1>a)b(?P=q_1)", "a{,2}b", "a{2,}", "a{,}", "a{1}", "a{", "{x}", "}", r"\w+",
    r"\W", r"\s", r"\S+", r"[\s\d]", r"[^\w]", r"[\W]", r"\bab\b", r"a\B", r"\v", r"\x61", r"\u00e9", r"\0", "(?i)AB", "(?m)^b",
    "(?s)a.b", "(?:a|b)c", "a(?=b)", "(?<!a)b", "a(?#note)b", "a++", "(?>a+)b", r"(a)\1", r"[\b]", "a|\\Z", "(?i:É)"]


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sampled_from(_DIALECT), st.text("abcxé_ \r\n\x0b\x1c\x85\u2028\u203f{}0²", max_size=12)
       | st.sampled_from(["a\rb", "a\x85b", "x\r", "x\u2028", "end\n", "end", "aab", "aba", "x\n"]))
def test_dialect(spark, pattern, value):
    """Dots, anchors, names, counts, classes and borders match what they match in Python."""
    assert one(spark, text.clean_text(F.lit(value), (pattern,))) == re.sub(pattern, "", value)


@pytest.mark.parametrize("pattern", ["(?x)a b", "(?a)a", "(a)?(?(1)b|c)"])
def test_what_java_lacks_is_refused(pattern):
    with pytest.raises(ValueError):
        text.java_pattern(pattern)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_PATTERNS, max_size=4), st.text("abcxyz-&^[]_é019２ *\\", max_size=25))
def test_any_list_deletes_what_python_deletes(spark, patterns, value):
    want = value
    try:
        for p in patterns:
            with warnings.catch_warnings():
                warnings.simplefilter("error")
                want = re.sub(p, "", want)
    except (re.error, FutureWarning):
        return  # no legal list
    assert one(spark, text.clean_text(F.lit(value), patterns)) == want


def test_order_matters_for_longer_patterns(spark):
    assert one(spark, text.clean_text(F.lit("abab"), ("ba", "ab"))) == ""
    assert one(spark, text.clean_text(F.lit("abab"), ("ab", "ba"))) == ""
    assert one(spark, text.clean_text(F.lit("a[1]-"), (r"\[", "-"))) == "a1]"


def test_words(spark):
    assert one(spark, text.words(F.lit(" a\tb\r\n c\x0bd\x0ce "))) == ["a", "b", "c", "d", "e"]
    assert one(spark, text.words(F.lit(""))) == []


@pytest.mark.parametrize("items", [
    ["a", "b"], ["it's"], ['say "x"'], ["it's \"x\""], ["a\nb", "c\\d"], [], ["\t\r"],
    ["全角　空格", "零​宽"], ["\x00\x1f\x7f\xa0"], ["𠀀", "\U000e0001"], ["\\'", "'"],
])
def test_python_list_text(spark, items):
    column = F.array(*[F.lit(i) for i in items]).cast("array<string>")
    assert one(spark, text.python_list_text(column)) == str(items)


def test_chat_text(spark):
    said = F.array(F.lit("hi"), F.lit("yo"), F.lit("ok"))
    assert one(spark, dialogue.chat_text(said)) == (
        "<s>Human: hi\n</s><s>Assistant: yo\n</s><s>Human: ok\n</s>")
    assert one(spark, dialogue.chat_text(F.array().cast("array<string>"))) == ""


def test_gather_turns_over_many_chunks(spark):
    long = spark.range(2_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.col("id").cast("string").alias("text"))
    short = spark.createDataFrame([(2, 1, "b"), (2, 0, "a")], long.schema)
    got = {r.conv_id: r.utterances for r in dialogue.gather_turns(long.unionByName(short)).collect()}
    assert got == {1: [str(i) for i in range(2_000)], 2: ["a", "b"]}


def test_dialogue_records(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "id int, utterances array<string>")
    rows = {r.id: r for r in dialogue.dialogue_to_instruction(df).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].instruction, rows[1].input, rows[1].output) == (
        fixed.DIALOGUE_INSTRUCTION, "a", ["b", "c"])
    assert rows[2].output == []


def test_maths_records(spark):
    df = spark.createDataFrame([("t", "x=1+1", "2")], "original_text string, equation string, ans string")
    r = dialogue.math_to_instruction(df).first()
    assert (r.instruction, r.input, r.output) == ("t", "根据方程式:x=1+1", "解得:2")
    assert dialogue.math_to_chat(df).first().text == (
        "<s>Human: t</s><s>Assistant: 根据方程式x=1+1解得:\n2</s>")


def test_prompt(spark):
    df = spark.createDataFrame([(1, "i", None, "o"), (2, "i", "", "o"), (3, "i", "q", None)],
                               "id int, instruction string, input string, output string")
    rows = {r.id: r for r in dialogue.build_prompt(df).collect()}
    head = ("[INST] <<SYS>>\nYou are a helpful assistant. 你是一个乐于助人的助手。你拥有非常丰富的知识。\n"
            "<</SYS>>\n\n")
    assert rows[1].source == rows[2].source == head + "i [/INST]"
    assert rows[3].source == head + "i\nq [/INST]"
    assert rows[1].target == "o</s>" and rows[3].target == "None</s>"
    lists = spark.createDataFrame([("i", "q", ["a", "b"])],
                                  "instruction string, input string, output array<string>")
    assert dialogue.build_prompt(lists).first().target == "['a', 'b']</s>"
    assert dialogue.build_prompt(lists, "join").first().target == "a\nb</s>"
