from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from textlode.sources import readers, writers


def test_one_gzip_file_per_category(spark, tmp_path):
    for name, texts in (("Books", ["a", "b"]), ("Home_and_Kitchen", ["c"])):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as out:
            out.writelines(json.dumps({"reviewText": t, "overall": 5.0}) + "\n" for t in texts)
    got = readers.read_json_lines(spark, str(tmp_path)).select("reviewText", "main_category").collect()
    assert sorted(tuple(r) for r in got) == [("a", "Books"), ("b", "Books"), ("c", "Home_and_Kitchen")]
    corpus = readers.load_corpus(spark, "reviews_json", paths=str(tmp_path))
    assert {"text", "label", "rating"} <= set(corpus.columns)


def test_missing_source_and_bad_line_are_reported(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as out:
        out.write('{"reviewText": "x", "overall": 1}\nnot json\n{"reviewText": "y", "overall": 2}\n')
    paths = {"a": str(tmp_path / "a.json.gz"), "b": str(tmp_path / "b.json.gz")}
    rows, status = readers.read_sources(spark, paths, "reviewText string, overall double")
    assert sorted(r.reviewText for r in rows.collect()) == ["x", "y"]
    assert sorted(tuple(r) for r in status.collect()) == [("a", "read", 2, 1), ("b", "missing", 0, 0)]
    rows, status = readers.read_sources(spark, {"b": paths["b"]}, "reviewText string")
    assert rows is None and status.first().status == "missing"


TEXTS = ['say "hi", you', "two\nlines", "back\\slash", "comma, here", "ünï", "", None, ' "quoted" ', "a\r\nb"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(TEXTS)], "id bigint, text string, label string")
    df = df.unionByName(spark.createDataFrame([(100, None, "l"), (101, "\\N", "l"), (102, "\\n\n\\\n\r\\", "l")], df.schema))
    writers.write_csv(df, str(tmp_path / "x"))
    back = readers.read_csv(spark, str(tmp_path / "x"), "id bigint, text string, label string", own=True)
    got = {r.id: r.text for r in back.collect()}
    assert got == {r.id: r.text for r in df.collect()}
    corpus = readers.read_csv_corpus(spark, str(tmp_path / "x"), "id bigint, text string, label string", own=True)
    assert corpus.where("text is null").count() == 0


def test_one_large_csv_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,text\n" + "".join(f"{i},some text of row {i}\n" for i in range(60_000)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "256k")
    try:
        df = readers.read_csv(spark, str(tmp_path / "big.csv"), "id bigint, text string")
        assert df.select(F.spark_partition_id()).distinct().count() > 1
        assert df.count() == 60_000 and df.where("text = 'some text of row ' || id").count() == 60_000
    finally:
        spark.conf.set(name, before)


def test_line_breaks_inside_fields_of_others(spark, tmp_path):
    (tmp_path / "x.csv").write_text('text,label\n"a\nb",x\n')
    assert [r.text for r in readers.read_csv(spark, str(tmp_path / "x.csv"), multiline=True).collect()] == ["a\nb"]


def test_csv_without_label_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("text,other\na,b\n")
    with pytest.raises(ValueError, match="label"):
        readers.read_csv_corpus(spark, str(tmp_path / "x.csv"))


def test_label_lines(spark, tmp_path):
    lines = [b"NUM:dist How far is it ?", b"  LOC:city  Where  is caf\xe9 ? ", b"ALONE", b"", b'HUM:ind Who said "x, y" ?', b"\xa0A b"]
    (tmp_path / "train.label").write_bytes(b"\n".join(lines) + b"\n")
    got = sorted(tuple(r) for r in readers.read_label_lines(spark, str(tmp_path / "train.label")).collect())
    want = []
    for line in lines:
        parts = line.decode("latin-1").strip().split(" ", 1)
        if len(parts) == 2:
            want.append(tuple(parts))
    assert got == sorted(want)


def test_label_lines_keep_control_characters(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"X one\x01two \x02 three\x00\x7f end\nY a\tb\x01\n")
    got = sorted(tuple(r) for r in readers.read_label_lines(spark, str(tmp_path / "a")).collect())
    assert got == [("X", "one\x01two \x02 three\x00\x7f end"), ("Y", "a\tb\x01")]


def test_label_lines_in_utf8(spark, tmp_path):
    (tmp_path / "a").write_bytes("X café\n".encode() + b"Y bad \xff byte\r\n")
    got = sorted(tuple(r) for r in readers.read_label_lines(spark, str(tmp_path / "a"), "UTF-8").collect())
    assert got == [("X", "café"), ("Y", "bad \ufffd byte")]


def test_label_files_keep_their_origin(spark, tmp_path):
    (tmp_path / "a").write_text("X one\nY two\n")
    (tmp_path / "b").write_text("X three\n")
    got = readers.read_label_files(spark, {"train": str(tmp_path / "a"), "test": str(tmp_path / "b")})
    assert sorted(tuple(r) for r in got.collect()) == [("X", "one", "train"), ("X", "three", "test"), ("Y", "two", "train")]


def test_newsgroups(spark, tmp_path):
    for subset in ("train", "test"):
        for name in ("sci.space", "rec.autos"):
            folder = tmp_path / subset / name
            folder.mkdir(parents=True)
            (folder / "1001").write_bytes(f"From: x\nSubject: y\n\nX wrote:\n> old\nbody {subset} caf\xe9\n\nsig".encode("latin-1"))
    got = readers.read_newsgroups(spark, str(tmp_path)).collect()
    assert {(r.subset, r.label, r.message) for r in got} == {
        (s, c, "1001") for s in ("train", "test") for c in ("sci.space", "rec.autos")
    }
    assert {r.text for r in got} == {"body train café", "body test café"}
    one = readers.read_newsgroups(spark, str(tmp_path), "test", ["sci.space"], remove=()).collect()
    assert len(one) == 1 and one[0].text.startswith("From: x")


def test_json_sink(spark, tmp_path):
    writers.write_json(spark.createDataFrame([(1, 0.5), (2, None)], "k int, f1 double"), str(tmp_path / "t"))
    got = spark.read.schema("k int, f1 double").json(str(tmp_path / "t")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0.5), (2, None)]


def test_head_slice_and_own_source(spark):
    df = spark.range(50).select("id", F.lit("t").alias("text"), F.lit("l").alias("label"))
    assert [r.id for r in readers.head_slice(df, "id", 3).collect()] == [0, 1, 2]
    assert readers.load_corpus(spark, lambda spark, n: df.limit(n), n=4).count() == 4
