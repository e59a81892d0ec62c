"""Hand-made rows: Unicode, blanks, URLs, keywords, scaling and lookups."""

import re

import pytest
from pyspark.sql import functions as F

from routewise.functions import numeric as N
from routewise.functions import text as T
from routewise.functions import wordstats as W


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first()["o"]


def test_no_break_space_words(spark):
    assert one(spark, T.word_count("v"), "a b c\u00a0d e") == 5


def test_emoji_length(spark):
    assert one(spark, T.char_count("v"), "\U0001F600") == 1


@pytest.mark.parametrize("blank", ["", "   ", "\t\n", None])
def test_blank_response(spark, blank):
    df = spark.createDataFrame([(blank, "instr", "", "Instruction: instr")], "r string, i string, x string, q string")
    r = df.select(W.redundancy("r").alias("red"), T.is_blank("r").alias("b"), T.word_count("r").alias("n"),
                  T.is_repetition("i", "x", "q", "r").alias("rep"),
                  T.is_trash("r", W.redundancy("r"), T.word_count("r"), F.lit(0.0)).alias("trash")).first()
    assert r["red"] == 1.0 and r["b"] and r["n"] == 0 and not r["rep"] and r["trash"]


def test_keyword_next_to_accent(spark):
    df = spark.createDataFrame([("éexplain explain, Explain_x re-explain", "")], "i string, x string")
    assert df.select(T.keyword_count("i", "x").alias("k")).first()["k"] == 2


def test_keywords_use_input_when_instruction_empty(spark):
    df = spark.createDataFrame([("", "please Explain and compare")], "i string, x string")
    assert df.select(T.keyword_count("i", "x").alias("k")).first()["k"] == 2


def test_both_parts_empty(spark):
    df = spark.createDataFrame([("", "")], "i string, x string")
    assert df.select(T.build_query("i", "x").alias("q")).first()["q"] == "Input: "


def test_query_forms(spark):
    df = spark.createDataFrame([("a", "b"), ("a", ""), ("", "b")], "i string, x string")
    assert [r["q"] for r in df.select(T.build_query("i", "x").alias("q")).collect()] == [
        "Instruction: a Input: b", "Instruction: a", "Input: b"]


def test_url_kinds(spark):
    df = spark.createDataFrame([("see http://x and https://x and ![a](b) end",)], "v string")
    r = df.select(T.remove_urls("v").alias("c"), T.contains_url("v").alias("u")).first()
    assert "http" not in r["c"] and "![a]" not in r["c"] and r["u"] == 1


def test_special_tokens(spark):
    assert one(spark, T.special_token_count("v"), "a:b;c\\d´e") == 4


def test_zero_range_scaling(spark):
    df = spark.createDataFrame([(3.0, 3.0, 3.0)], "x double, lo double, hi double")
    assert df.select(N.minmax("x", "lo", "hi").alias("s")).first()["s"] == 0.0
    assert df.select(N.normalize_metric(F.col("x"), "bleu", F.col("lo"), F.col("hi")).alias("s")).first()["s"] == 0.0


def test_near_tie_rounding(spark):
    assert spark.sql("SELECT round(0.12345D, 4) AS r").first()["r"] == 0.1235


def test_argmax_first_max(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2)], "a double, b double, c double")
    assert df.select(N.argmax_label("a", "b", "c").alias("l")).first()["l"] == 1


def test_confidence_threshold_one(spark):
    from routewise.operators.routing import route_by_confidence
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.99, 0.01, 0.0)], "proba_base double, proba_large double, proba_xl double")
    got = [r["r"] for r in df.select(route_by_confidence(threshold=1.0).alias("r")).collect()]
    assert got == [1, 3]


def test_unknown_category_weight(spark):
    df = spark.createDataFrame([(15,), (5,)], "c int")
    got = [r["w"] for r in df.select(N.category_weight(N.category_name("c")).alias("w")).collect()]
    assert got == [0.03, 1.0]


def test_redundancy_values(spark):
    # words: "aa aa b" -> word level 1/3; char level mean(1/2, 1/2, 0) = 1/3
    assert one(spark, W.redundancy("v"), "aa aa b") == pytest.approx(1 / 3)
    assert one(spark, W.redundancy("v"), "abc def") == 0.0


def test_word_dictionary(spark):
    """Word splitting agrees with the native expression on all white space; a full dictionary starts afresh."""
    spaces = [chr(i) for i in range(0x3100) if re.match(r"\s", chr(i)) or i in (0x1c, 0x1f, 0x200b, 0x180e)]
    rows = [("a" + c + "bb" + c + c + "a",) for c in spaces] + [(None,), ("",), (" \n ",), ("x" * 50000 + " y",), ("\U0001F600\U0001F600 é",)]
    df = spark.createDataFrame(rows, "v string")
    w = T.words("v")
    got = df.select(W.word_stats("v").alias("s"), F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"),
                    F.aggregate(F.transform(w, lambda x: (F.length(x) - F.size(F.array_distinct(F.split(x, "")))) / F.length(x)),
                                F.lit(0.0), lambda a, x: a + x).alias("r")).collect()
    assert all((r["s"]["length"], r["s"]["distinct"], r["s"]["repeated"]) == (r["n"], r["d"], r["r"]) for r in got)


def test_word_dictionary_is_bounded(monkeypatch):
    monkeypatch.setattr(W, "REMEMBERED", 3)
    known = W.Repetition()
    words = ["aa", "bbb", "c", "dd", "aa", "eé", "bbb"]
    assert [known[x] for x in words] == [1 / 2, 2 / 3, 0, 1 / 2, 1 / 2, 0, 2 / 3] and len(known) <= 3


def test_word_statistics_from_bytes_equal_the_plain_ones(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(W, "CHUNK_BYTES", 40)
    texts = [None, "", " ", "a b   c aa", " x aa\x1cbb cc", "éé aa \u3000", "na " * 150, "\x1f", "word\x85two aa", "𝒳𝒳 a", "zz\u2003", "a" * 99, "\xa0", "ñoño b0b \t"]
    plain = W.text_stats(texts, lambda w: (len(w) - len(set(w))) / len(w), W.split_words)
    assert W.batch_stats(pa.array(texts), W.Repetition().__getitem__) == plain
    assert W.batch_stats(pa.array(texts).slice(3, 7), W.Repetition().__getitem__) == tuple(c[3:10] for c in plain)
    assert W.batch_stats(pa.array([], pa.string()), W.Repetition().__getitem__) == ([], [], [])


def test_readability_definition(spark):
    # 2 words, 1 sentence, syllables: "hello" 2 groups (e, o) + "world" 1 = 3
    got = one(spark, T.readability_grade("v"), "Hello world.")
    assert got == pytest.approx(0.39 * 2 / 1 + 11.8 * 3 / 2 - 15.59)
    assert one(spark, T.readability_grade("v"), "") == 0.0
    # "xyz" has one vowel group (y), the vowel-less "brr" still counts one syllable
    assert one(spark, T.readability_grade("v"), "xyz brr") == pytest.approx(0.39 * 2 + 11.8 * 2 / 2 - 15.59)


def test_repetition_forms(spark):
    rows = [("  do it ", "", "Instruction:  do it ", "do it"),
            ("", "text", "Input: text", " text "),
            ("a", "b", "Instruction: a Input: b", "ab"),
            ("a", "b", "Instruction: a Input: b", "Instruction: a Input: b"),
            ("a", "b", "Instruction: a Input: b", "something else")]
    df = spark.createDataFrame(rows, "i string, x string, q string, r string")
    got = [r["p"] for r in df.select(T.is_repetition("i", "x", "q", "r").alias("p")).collect()]
    assert got == [True, True, True, True, False]
