from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textlode.operators import pairs as P
from textlode.operators import tfidf


@pytest.fixture(scope="module")
def truth(corpus):
    return {r.id: r for r in corpus.collect()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_positive_pairs(corpus, truth):
    got = P.positive_pairs(corpus, 500).collect()
    assert len(got) == 500 and len({r.pair_id for r in got}) == 500
    for r in got:
        assert r.id_a != r.id_b and truth[r.id_a].label == truth[r.id_b].label == r.label
        assert (truth[r.id_a].text, truth[r.id_b].text) == (r.text_a, r.text_b)
    # Classes are drawn alike, however large they are.
    drawn = Counter(r.label for r in got)
    assert len(drawn) == 8 and max(drawn.values()) < 2.5 * min(drawn.values())


def test_classes_of_one_row_are_skipped(spark):
    df = spark.createDataFrame([(1, "x", "one"), (2, "y", "two"), (3, "z", "two")], "id bigint, text string, label string")
    got = P.positive_pairs(df, 100).collect()
    assert 0 < len(got) < 100 and {frozenset((r.id_a, r.id_b)) for r in got} == {frozenset((2, 3))}


def test_labelled_pairs(corpus, truth):
    got = P.labelled_pairs(corpus, 300).collect()
    assert len(got) == 600 and Counter(r.label for r in got) == {1.0: 300, 0.0: 300}
    for r in got:
        assert (truth[r.id_a].label == truth[r.id_b].label) == (r.label == 1.0) and r.id_a != r.id_b


def test_mixed_pairs_are_cut_to_size(corpus):
    assert P.mixed_pairs(corpus, 101).count() == 100
    assert P.mixed_pairs(corpus, 100).count() == 100


@pytest.mark.parametrize("make", [P.positive_pairs, P.labelled_pairs, P.hard_negative_pairs, P.positive_combinations, P.validation_pairs])
def test_same_pairs_without_broadcast(corpus, make, no_broadcast):
    forced = rows(make(corpus, 60))
    no_broadcast()
    assert forced == rows(make(corpus.repartition(3), 60))


def test_combinations_are_different_and_capped(corpus, truth):
    got = P.positive_combinations(corpus, 400).collect()
    sizes = Counter(r.label for r in truth.values())
    count = Counter(r.label for r in got)
    assert count == {c: min(n * (n - 1) // 2, 400 // len(sizes)) for c, n in sizes.items()}
    assert len({frozenset((r.id_a, r.id_b)) for r in got}) == len(got)
    assert all(truth[r.id_a].label == truth[r.id_b].label == r.label for r in got)


def test_all_combinations_of_small_classes(spark):
    data = [(i, f"t{i}", "even" if i < 6 else "odd") for i in range(11)]
    got = P.positive_combinations(spark.createDataFrame(data, "id bigint, text string, label string"), 1000).collect()
    assert {frozenset((r.id_a, r.id_b)) for r in got} == {
        frozenset((a, b)) for a, _, la in data for b, _, lb in data if a < b and la == lb
    }


@pytest.mark.parametrize("n", [2, 3, 4, 7, 10])
def test_pair_numbers_are_a_bijection(spark, n):
    df = spark.range(n * (n - 1) // 2).select(F.lit(n).cast("bigint").alias("n"), F.col("id").alias("number"))
    got = [(r.pos_a, r.pos_b) for r in P.pair_of_number(df, "number").collect()]
    assert sorted(got) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_draws_are_different_beyond_bigint(spark):
    df = spark.sql("select 'c' as label, 1000 as take, cast('500000000000000000000' as decimal(23,0)) as size")
    got = [int(r.number) for r in P.distinct_draws(df, "take", "size", ["label"], "x", 1, "number").collect()]
    assert len(set(got)) == 1000 and max(got) > 2**63 and min(got) >= 0 and max(got) < 5 * 10**20


def vectors(texts):
    terms = {i: Counter(re.findall(r"\b\w\w+\b", t.lower())) for i, t in texts.items()}
    df = Counter(t for c in terms.values() for t in c)
    out = {}
    for i, c in terms.items():
        w = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {t: x / length for t, x in w.items()}
    return out


@pytest.mark.parametrize("forced", [False, True])
def test_tfidf(corpus, truth, request, forced):
    if forced:
        request.getfixturevalue("no_broadcast")
    got = defaultdict(dict)
    for r in tfidf.tfidf(corpus).collect():
        got[r.id][r.term] = r.weight
    want = vectors({i: r.text for i, r in truth.items()})
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i])


@pytest.mark.parametrize("most", [0, 5, 1 << 17])
def test_tfidf_with_few_frequent_terms(spark, monkeypatch, no_broadcast, most):
    """Ids that repeat or are null are one document, whatever share of the terms every task holds; no row of a term and a document meets the vocabulary twice."""
    rows = [(i % 50 if i % 7 else None, f"Word{i % 3} common common w{i} x{i % 20}") for i in range(120)] + [(60, None), (61, "- a"), (62, "common")]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    monkeypatch.setattr(tfidf, "FREQUENT", most)
    monkeypatch.setattr(tfidf, "TASK_PAIRS", 30)
    texts, df = defaultdict(list), Counter()
    for i, text in rows:
        found = re.findall(r"\w{2,}", (text or "").lower())
        texts[i] += found
        df.update(set(found))
    got = defaultdict(dict)
    for r in tfidf.tfidf(docs).collect():
        assert r.term not in got[r.id]
        got[r.id][r.term] = r.weight
    assert got.keys() == {i for i, found in texts.items() if found}
    raw = {i: {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in Counter(found).items()} for i, found in texts.items() if found}
    want = {i: {t: x / math.sqrt(sum(y * y for y in own.values())) for t, x in own.items()} for i, own in raw.items()}
    for i, own in want.items():
        assert got[i] == pytest.approx(own)
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 3), (2, 1, 62), (3, 61, 1), (4, None, 1), (5, 1, 2), (5, 1, 3)], "key int, id_a bigint, id_b bigint")
    found = [(r.key, r.id_a, r.id_b, r.similarity) for r in tfidf.pair_similarity(docs, pairs, ["key"], "id", "text").collect()]
    cosine = lambda a, b: sum(x * want.get(b, {}).get(t, 0.0) for t, x in want.get(a, {}).items())
    sums = {key: sum(cosine(a, b) for k, a, b in ((r.key, r.id_a, r.id_b) for r in pairs.collect()) if k == key and a is not None) for key in range(6)}
    assert len(found) == 7 and all(s == pytest.approx(sums[key]) for key, _, _, s in found)


def shuffled_rows(frame):
    """Rows that leave each exchange of a plan that has run."""
    found, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_frequent_terms_are_not_shuffled(spark, no_broadcast):
    """However large the vocabulary is: texts travel once, not a row for each term of each document."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 40}" for j in range(60))) for i in range(300)], "id bigint, text string").repartition(3)
    weights = tfidf.tfidf(docs)
    n = len(weights.collect())
    assert n > 3000 and max(shuffled_rows(weights)) <= 300


def test_hard_negatives_take_the_most_similar(spark, corpus, truth):
    want = vectors({i: r.text for i, r in truth.items()})
    classes, _ = P.class_table(corpus)
    drawn, _, _ = P.drawn_classes(corpus, "label", 40, 7)
    tries = P.outside_positions(drawn, 5, 7)
    assert {r["count"] for r in tries.groupBy("draw_id").count().collect()} == {5}
    assert tries.groupBy("draw_id").agg(F.count_distinct("spot").alias("n")).where("n < 5").count() == 0
    anchors = drawn.withColumn("id_a", F.lit(1).cast("bigint"))
    got = P.hardest_negatives(corpus, anchors, classes, 5, "id", "label", "text", 7).collect()
    assert len(got) == 40
    for r in got:
        same = sum(w * want[r.id_b].get(t, 0.0) for t, w in want[1].items())
        assert r.similarity == pytest.approx(same)


def test_hard_negative_pairs(corpus, truth):
    got = P.hard_negative_pairs(corpus, 80).collect()
    assert Counter(r.label for r in got) == {1: 40, 0: 40}
    anchors = {r.pair_id // 2: r.id_a for r in got if r.label == 1}
    for r in got:
        assert (truth[r.id_a].label == truth[r.id_b].label) == (r.label == 1)
        assert anchors[r.pair_id // 2] == r.id_a


def test_fewer_outsiders_than_candidates(spark):
    data = [(i, f"word{i} same", "a") for i in range(10)] + [(20, "same thing", "b"), (21, "word1 thing", "b")]
    df = spark.createDataFrame(data, "id bigint, text string, label string")
    got = [r for r in P.hard_negative_pairs(df, 40).collect() if r.label == 0]
    assert got and all((r.id_a < 20) != (r.id_b < 20) for r in got)


def test_validation_pairs(corpus, truth):
    got = P.validation_pairs(corpus, 200).collect()
    assert len(got) == 200
    for r in got:
        assert (truth[r.id_a].label == truth[r.id_b].label) == (r.label == 1)
    assert 60 < sum(r.label for r in got) < 140


def test_validation_pairs_of_a_tiny_corpus_are_all_pairs(spark):
    data = [(i, f"t{i} x{i}", "a" if i < 3 else "b") for i in range(5)]
    got = P.validation_pairs(spark.createDataFrame(data, "id bigint, text string, label string"), 1000).collect()
    assert Counter(r.label for r in got) == {1: 4, 0: 4}


def test_text_with_empty(spark):
    df = spark.createDataFrame([(1, "x", 2)], "id bigint, text string, label_id int")
    assert tuple(P.text_with_empty(df).first()) == (1, "x", "", 2.0)
