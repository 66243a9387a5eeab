from __future__ import annotations

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import clean, profile

ODD = ["a b", "  a\t b\n", "", "   ", " ", "a b c", "\x1ca b\x1f", "x\u0085y", None, "one", " é è ", "a​b"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_strip_and_words_follow_python(spark):
    rows = frame(spark, ODD).select("text", T.strip("text").alias("s"), T.words("text").alias("w"), T.word_count("text").alias("n"))
    for row in rows.collect():
        if row.text is None:
            assert row.s is None and row.n is None
        else:
            assert row.s == row.text.strip()
            assert row.w == row.text.split()
            assert row.n == len(row.text.split())


def test_explode_words(spark):
    got = sorted(r.word for r in T.explode_words(frame(spark, ODD), "text").collect())
    assert got == sorted(w for t in ODD if t for w in t.split())


def test_stop_words_are_sparks():
    assert T.STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_terms(spark):
    got = frame(spark, ["A bc, d_e f2 été x"]).select(T.terms("text").alias("t")).first().t
    assert got == ["bc", "d_e", "f2", "été"]


@pytest.mark.parametrize(
    "message, remove, left",
    [
        ("From: a\nSubject: b\n\nbody\nmore", ("headers",), "body\nmore"),
        ("no header", ("headers",), ""),
        ("body\n\nname", ("footers",), "body"),
        ("body\n--\nname", ("footers",), "body"),
        ("body only", ("footers",), "body only"),
        ("> old\nnew\n| old\nX wrote:\nIn article 5\nlast", ("quotes",), "new\nlast"),
        ("H: x\n\n> q\nbody\n---\nsig", ("headers", "footers", "quotes"), "body"),
        ("as is\n> q", (), "as is\n> q"),
    ],
)
def test_strip_message(spark, message, remove, left):
    assert clean.strip_messages(frame(spark, [message]), "text", remove).first().text == left


def test_trim_drops_blank_and_null(spark):
    got = [r.text for r in clean.trim_text(frame(spark, ODD)).orderBy("id").collect()]
    assert got == [t.strip() for t in ODD if t and t.strip()]


def test_rename_and_require(spark):
    raw = spark.createDataFrame([("t", "l", 1.0, 2.0)], "reviewText string, main_category string, overall double, rating double")
    assert clean.rename_columns(raw).columns == ["text", "label", "overall", "rating"]
    with pytest.raises(ValueError, match="label"):
        clean.require_columns(raw.select(F.col("reviewText").alias("text")))


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, "y")], "id int, b string")
    got = clean.union_all([a, b]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "x", None), (2, None, "y")]


def test_row_ids_are_stable_and_tell_copies_apart(spark):
    rows = [("same", "l")] * 25 + [("other", None), (None, "l")]
    df = spark.createDataFrame(rows, "text string, label string")
    one = sorted(r.id for r in clean.with_row_id(df.repartition(1), chunk=10).collect())
    many = sorted(r.id for r in clean.with_row_id(df.repartition(9), chunk=10).collect())
    assert one == many and len(set(one)) == 27


def test_histogram_of_a_constant_has_one_bin(spark):
    got = profile.length_histogram(frame(spark, ["ab", "cd", "ef"]), F.length("text")).collect()
    assert [(r.bin, r.n) for r in got] == [(1, 3)]


def test_histogram_counts_all_values_and_the_maximum_is_in_the_last_bin(spark):
    got = {r.bin: r.n for r in profile.length_histogram(frame(spark, ["x" * n for n in range(1, 102)]), F.length("text")).collect()}
    assert sum(got.values()) == 101 and max(got) == 50 and got[50] == 3


def test_null_counts_and_averages(spark):
    df = frame(spark, ["a b", None, "abc"])
    assert {r["column"]: r.nulls for r in profile.null_counts(df).collect()} == {"id": 0, "text": 1}
    row = profile.average_lengths(df).first()
    assert (row.avg_chars, row.avg_words, row.null_texts) == (3.0, 1.5, 1)


def test_flags(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [(None,)], "label string")
    assert profile.class_balance(df).first().skewness == "Highly Skewed"
    many = spark.range(21).select(F.col("id").cast("string").alias("label"))
    assert profile.class_complexity(many).first().complexity == "High"
    assert profile.class_balance(many).first().skewness == "Balanced"
    assert profile.top_categories(df, "category") is None


def test_vocabulary(spark):
    df = frame(spark, ["a b a", "B c"])
    assert profile.vocabulary_size(df).first()[0] == 4
    assert profile.vocabulary_size(df, approximate=True).first()[0] == 4
    assert [tuple(r) for r in profile.word_frequency(frame(spark, ["The cat the Dog cat", "dog cat"]), 5).collect()] == [
        ("cat", 3),
        ("dog", 2),
    ]
