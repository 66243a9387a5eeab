"""The similarity join against brute force over all pairs, its bounds, and edge rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from textlode.llm import nearjoin
from textlode.llm.queries import ngram_jaccard_join


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((doc, len(s), least[root(i)]) for i, (doc, s) in enumerate(sets))


def rows_of(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def variants(rng, n_base, n_copies, words, rate):
    """Texts with chains of changed copies, so that similarities lie on both sides of the threshold."""
    out = []
    for b in range(n_base):
        text = [f"w{rng.randrange(4000)}" for _ in range(rng.choice(words))]
        for _ in range(n_copies):
            out.append(" ".join(text))
            text = [w if rng.random() > rate else f"w{rng.randrange(4000)}" for w in text]
            if rng.random() < 0.3:
                text = text[: max(1, len(text) - rng.randrange(6))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("words", "rate"), [((3, 6, 9, 14), 0.02), ((20, 40, 70), 0.02), ((150, 300), 0.015)])
def test_equals_brute_force(spark, words, rate):
    texts = variants(random.Random(sum(words)), 12, 14, words, rate)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(nearjoin.similar_classes(docs)) == brute(rows)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(ngram_jaccard_join(spark, folder)) == brute(rows)


def test_groups_that_share_a_passage_but_are_no_copies(spark):
    """Keys shared by texts that do not link to the smallest one: the blocks have to find the other links."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(30):
        own = [f"o{i // 3}x{j}" for j in range(25)]
        own[rng.randrange(25)] = f"change{i}"
        rows.append((i, " ".join(shared + own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(nearjoin.similar_classes(docs)) == brute(rows)


def test_keys_of_any_two_similar_sets_meet():
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 11, 15, 16, 17, 40, 63, 64, 100, 255, 256, 300, 1023, 1024, 1500]:
        for _ in range(30):
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            gone = rng.integers(0, n // 4 + 1)
            new = rng.integers(0, n // 4 + 1 - gone) if n // 4 + 1 - gone > 0 else 0
            other = np.unique(np.r_[base[rng.permutation(n)[gone:]], rng.integers(0, 2**63, new, dtype=np.uint64)])
            both = len(np.intersect1d(base, other))
            if 4 * both < 3 * (len(base) + len(other) - both) or not len(other):
                continue
            assert len(np.intersect1d(nearjoin.keys_of(base), nearjoin.keys_of(other)))
            most = (len(base) + len(other)) // 7
            assert nearjoin.hamming(nearjoin.dense_sketch(base), nearjoin.dense_sketch(other)) <= most


def test_edge_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \n", 9), (4, "Same Words", 9), (5, "same\twords ", 9), (5, "same\twords ", 9), (None, "same words", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    found = sorted(nearjoin.similar_classes(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [tuple(r) for r in found] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, None)]
    left = nearjoin.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 2, 3, 4]
    assert nearjoin.similar_classes(docs.where("false")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r["node"]: r["label"] for r in nearjoin.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_group_of_many_components_stays_linear(spark, monkeypatch):
    """Texts that share a long passage but are no copies: every two of a group are compared, and few rows are made for that."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = {i: " ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(25)]) for i in range(2600)}
    # Some are copies of others but for a word.
    for i in range(0, 200, 2):
        texts[i + 1] = texts[i] + " end"
    made = []
    blocks = nearjoin._in_blocks

    def counted(rows, most_rows, most_shingles):
        out = blocks(rows, most_rows, most_shingles)
        made.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(nearjoin, "_in_blocks", counted)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8)
    found = {r["doc_id"]: r["component_id"] for r in nearjoin.similar_classes(df).collect()}
    assert found == {i: i - 1 if i < 200 and i % 2 else i for i in texts}
    assert all(b <= 2 * a for a, b in made)
