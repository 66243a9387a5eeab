from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textlode.operators import scale


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_attach_matches_null_keys_only_with_null_keys(spark, how):
    big = spark.createDataFrame([(i, [None, "a", "b", "c"][i % 4]) for i in range(80)], "row int, grp string")
    small = spark.createDataFrame([(None, 0), ("a", 1), ("b", 2)], "grp string, value int")
    got = sorted(tuple(r) for r in scale.attach(big, small, ["grp"], how).orderBy("row").collect())
    value = {None: 0, "a": 1, "b": 2}
    rows = [(i, [None, "a", "b", "c"][i % 4]) for i in range(80)]
    want = {
        "inner": [(*r, value[r[1]]) for r in rows if r[1] in value],
        "left": [(*r, value.get(r[1])) for r in rows],
        "left_semi": [r for r in rows if r[1] in value],
        "left_anti": [r for r in rows if r[1] not in value],
    }[how]
    assert got == sorted(want)


def test_a_hot_key_gives_the_same_rows_without_broadcast(spark, no_broadcast):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("row"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("value"))
    forced = sorted(tuple(r) for r in scale.attach(big, small, ["k"]).collect())
    no_broadcast()
    assert forced == sorted(tuple(r) for r in scale.attach(big, small, ["k"]).collect())


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), i, rng.randrange(9)) for i in range(700)]
    df = spark.createDataFrame(rows, "grp string, place int, n int").repartition(7)
    got = {(r.grp, r.place): (r.before, r.ones) for r in scale.running_sums(df.withColumn("one", F.lit(1)), ["grp"], ["place"], {"before": "n", "ones": "one"}).collect()}
    assert got == {
        (g, p): (sum(n for h, q, n in rows if h == g and q < p), sum(h == g and q < p for h, q, _ in rows)) for g, p, _ in rows
    }


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.x == 999 - r.place for r in scale.numbered(df, [F.desc("x")], "place").collect())
    assert scale.numbered(df.where("false"), ["x"], "place").count() == 0


def test_stage_cuts_the_lineage(spark):
    staged = scale.stage(spark.range(10).where("id > 3"))
    assert staged.count() == 6 and "Range" not in staged._jdf.queryExecution().logical().toString()


class FakeSession:
    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_the_shared_folder_comes_from_the_session():
    warehouse = {"spark_sql_warehouse_dir": "file:/warehouse"}
    assert scale.new_path(FakeSession(spark_checkpoint_dir="/some/folder/", **warehouse), "x").startswith("/some/folder/textlode/x-")
    assert scale.shared_dir(FakeSession(**warehouse)) == "file:/warehouse"
