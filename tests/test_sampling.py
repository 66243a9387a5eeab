from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textlode.operators import cuts, labels, splits


def key(salt, i, seed=42):
    return hashlib.md5(f"{seed}:{salt}:{i}".encode()).hexdigest()


def order(ids, salt):
    return sorted(ids, key=lambda i: (key(salt, i), i))


@pytest.mark.parametrize("n", [0, 1, 100, 600, 10_000])
def test_sample_is_exact_and_the_first_by_key(spark, corpus, n):
    got = {r.id for r in splits.sample_rows(corpus, n).collect()}
    assert got == set(order(range(600), "sample")[:n])


def test_sample_is_the_same_for_any_partitioning(spark, corpus):
    one = {r.id for r in splits.sample_rows(corpus.repartition(1), 50).collect()}
    assert one == {r.id for r in splits.sample_rows(corpus.repartition(17), 50).collect()}


def test_cap_per_source(spark, corpus):
    got = Counter(r.label for r in splits.cap_per_source(corpus, 30, "label").collect())
    have = Counter(r.label for r in corpus.collect())
    assert got == {c: min(30, n) for c, n in have.items()}


def test_cap_without_broadcast(spark, corpus, no_broadcast):
    got = {r.id for r in splits.cap_per_source(corpus, 30, "label").collect()}
    by_label = {}
    for r in corpus.collect():
        by_label.setdefault(r.label, []).append(r.id)
    assert got == {i for ids in by_label.values() for i in order(ids, "cap")[:30]}


@pytest.mark.parametrize("rows, test_size", [(600, 0.2), (7, 0.3), (1, 0.2)])
def test_random_split_sizes(spark, corpus, rows, test_size):
    part = corpus.where(F.col("id") < rows)
    got = Counter(r.split for r in splits.random_split(part, test_size).collect())
    assert got["test"] == math.ceil(test_size * rows) and sum(got.values()) == rows


def quota(sizes, wanted):
    total = sum(sizes.values())
    base = {c: wanted * n // total for c, n in sizes.items()}
    rest = sorted(sizes, key=lambda c: (-(wanted * sizes[c] % total), c))
    for c in rest[: wanted - sum(base.values())]:
        base[c] += 1
    return base


def test_three_way_split(spark, corpus):
    got = splits.three_way_split(corpus).collect()
    assert len(got) == 600 and len({r.id for r in got}) == 600
    sizes = Counter(r.label for r in got)
    test = quota(sizes, math.ceil(0.2 * 600))
    rest = {c: n - test[c] for c, n in sizes.items()}
    val = quota(rest, math.ceil(0.1 * sum(rest.values())))
    assert Counter(r.label for r in got if r.split == "test") == test
    assert Counter(r.label for r in got if r.split == "val") == val
    by_label = {}
    for r in got:
        by_label.setdefault(r.label, []).append(r.id)
    split = {r.id: r.split for r in got}
    for c, ids in by_label.items():
        placed = order(ids, "strat")
        assert {split[i] for i in placed[: test[c]]} <= {"test"}
        assert {split[i] for i in placed[test[c] : test[c] + val[c]]} <= {"val"}


def test_split_without_broadcast_is_the_same(spark, corpus, no_broadcast):
    forced = {r.id: r.split for r in splits.three_way_split(corpus).collect()}
    no_broadcast()
    assert forced == {r.id: r.split for r in splits.three_way_split(corpus).collect()}


def test_too_small_class_fails(spark):
    df = spark.createDataFrame([(i, "a") for i in range(10)] + [(10, "b")], "id bigint, label string")
    with pytest.raises(ValueError, match="fewer than 2"):
        splits.stratified_split(df)
    few = spark.createDataFrame([(i, str(i // 2)) for i in range(20)], "id bigint, label string")
    with pytest.raises(ValueError, match="classes"):
        splits.stratified_split(few, 0.1)


def test_holdout(spark):
    rows = [(i, "a") for i in range(40)] + [(100 + i, "few") for i in range(3)] + [(200 + i, "many") for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, label string")
    got = splits.split_corpus(df, ["few", "many", "unknown"]).collect()
    count = Counter((r.label, r.split) for r in got)
    assert count[("few", "holdout_example")] == 3 and ("few", "holdout_test") not in count
    assert count[("many", "holdout_example")] == 5 and count[("many", "holdout_test")] == 25
    assert {r.split for r in got if r.label == "a"} == {"train", "val", "test"}
    assert len(got) == len(rows)


def test_no_holdout_is_empty(spark, corpus):
    parts = splits.split_corpus(corpus)
    assert splits.rows_of(parts, "holdout_example", "holdout_test").count() == 0
    assert splits.holdout_split(corpus, []).count() == 0


def test_positions(spark, corpus):
    rows = cuts.keyed(corpus, "id", "label", "p")
    place = {}
    for label in {r.label for r in corpus.collect()}:
        ids = [r.id for r in corpus.collect() if r.label == label]
        for pos, i in enumerate(order(ids, "p")):
            place[(label, pos)] = (i, len(ids))
    wanted = [(label, pos, total) for (label, pos), (_, total) in place.items()]
    asked = spark.createDataFrame(wanted, "grp string, pos bigint, total bigint")
    got = {(r.grp, r.pos): r.id for r in cuts.rows_at(rows, asked).collect()}
    assert got == {k: i for k, (i, _) in place.items()}
    dense = {(r.grp, r.pos): r.id for r in cuts.dense_positions(rows).collect()}
    assert dense == got


def test_positions_with_crowded_buckets(spark, corpus, monkeypatch):
    """One bucket in all: the ranking within the bucket does the work."""
    monkeypatch.setattr(cuts, "bucket_of", lambda key: F.lit(0))
    got = {r.id for r in splits.cap_per_source(corpus, 30, "label").collect()}
    by_label = {}
    for r in corpus.collect():
        by_label.setdefault(r.label, []).append(r.id)
    assert got == {i for ids in by_label.values() for i in order(ids, "cap")[:30]}


def test_labels(spark, corpus):
    names = sorted({r.label for r in corpus.collect()})
    coded = labels.encode_labels(corpus)
    assert all(names[r.label_id] == r.label for r in coded.collect())
    used = labels.labels_in_use(coded.where("label_id < 2"), labels.label_dictionary(corpus))
    back = labels.decode_labels(coded.where("label_id < 2").drop("label"), used)
    assert {r.label for r in back.collect()} == set(names[:2])


@pytest.fixture(scope="module")
def nullable(spark):
    """400 rows, 100 of them without a label."""
    rows = [(i, None if i % 4 == 0 else f"c{i % 3}") for i in range(400)]
    return spark.createDataFrame(rows, "id bigint, label string").repartition(3)


def test_null_labels_are_a_class_of_their_own(nullable):
    count = Counter(r.label for r in splits.cap_per_source(nullable, 10, "label").collect())
    assert count == {None: 10, "c0": 10, "c1": 10, "c2": 10}
    got = splits.stratified_split(nullable, 0.2).collect()
    assert len(got) == 400 and Counter(r.split for r in got) == {"test": 80, "train": 320}
    assert Counter(r.label for r in got if r.split == "test") == {None: 20, "c0": 20, "c1": 20, "c2": 20}
    three = Counter(r.split for r in splits.three_way_split(nullable).collect())
    assert three == {"test": 80, "val": 32, "train": 288}


def test_rows_without_a_label_are_not_held_out(nullable):
    got = splits.split_corpus(nullable, ["c1"]).collect()
    assert len(got) == 400
    assert Counter(r.split for r in got if r.label == "c1") == {"holdout_example": 5, "holdout_test": 95}
    assert Counter(r.split for r in got if r.label is None) == {"test": 20, "val": 8, "train": 72}


def test_null_labels_keep_their_rows_when_encoded(nullable):
    got = labels.encode_labels(nullable).collect()
    assert len(got) == 400 and all((r.label is None) == (r.label_id is None) for r in got)


def test_many_classes_without_a_window_over_all(spark):
    df = spark.range(200_000).select("id", F.format_string("class %06d", F.col("id") % 100_000).alias("label"))
    names = labels.label_dictionary(df)
    # The only window over everything is that over the table of ranges, one row per partition.
    plan = names._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1 and "_range" in plan
    assert names.count() == 100_000
    got = names.where("label IN ('class 000000', 'class 054321', 'class 099999')").collect()
    assert {r.label: r.label_id for r in got} == {"class 000000": 0, "class 054321": 54321, "class 099999": 99999}
