import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from textlode.llm import merkle


def H(text):
    return sha256(text.encode()).hexdigest()


def tree(nodes):
    """(root, proof per leaf) by plain recomputation of every level."""
    proofs = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, proof in enumerate(proofs):
            if (at[i] ^ 1) < len(nodes):
                proof.append(nodes[at[i] ^ 1])
        nodes = [H("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [x // 2 for x in at]
    return nodes[0], proofs


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 21])
def test_appender_gives_the_tree_of_all_its_leaves(n):
    leaves = [H(str(i)) for i in range(n)]
    grown = merkle.Appender()
    for leaf in leaves:
        grown.append(leaf)
    root = grown.close()
    want, proofs = tree(leaves)
    assert root == want
    assert [[x[1:] for x in w if x] for w in grown.witnesses] == proofs


def test_partial_witnesses_reach_the_top_of_their_open_subtree():
    grown = merkle.Appender()
    for i in range(6):
        grown.append(H(str(i)))
    assert [(h, first) for h, first, _ in grown.open] == [(2, 0), (1, 4)]
    assert [len(w) for w in grown.witnesses] == [2, 2, 2, 2, 1, 1]


def brute(rows):
    groups = {}
    for group, key, leaf in rows:
        groups.setdefault(group, []).append(((key is not None, key or 0), leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([leaf for _, leaf in sorted(groups[g])]) for g in names}
    root, tops = tree([built[g][0] for g in names])
    out = []
    for place, g in enumerate(names):
        subroot, proofs = built[g]
        for (_, leaf), proof in zip(sorted(groups[g]), proofs, strict=True):
            out.append((g, leaf, subroot, root, "".join(proof + tops[place])))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [2, 4, 512])
def test_prove_equals_plain_trees(spark, size):
    rng = random.Random(size)
    groups = ["big"] * 6 + [None, "é", "z", "", "one"]
    rows = [(rng.choice(groups), rng.choice([None, i, i // 2]), f"t{i % 40}", "kept") for i in range(150)]
    rows += [("lone", 1, "x", "kept")] + [("big", 7, "same", "kept")] * 3
    df = spark.createDataFrame(rows, "lang string, doc_id bigint, text string, root string").repartition(5)
    df = df.withColumn("leaf", merkle.leaf_of(F.col("doc_id"), F.col("text")))
    proved = merkle.prove(df, "lang", "doc_id", size=size)
    got = proved.select("lang", "leaf", "subroot", "root", merkle.siblings(F.col("witness")).alias("p")).collect()
    want = brute([(r["lang"], r["doc_id"], r["leaf"]) for r in df.collect()])
    assert sorted(map(tuple, got), key=str) == want
    folded = proved.select(merkle.fold(F.col("leaf"), F.col("witness")).alias("x"), "root")
    assert folded.where("x <> root").count() == 0
    other = proved.select(merkle.fold(F.sha2(F.lit("other"), 256), F.col("witness")).alias("x"), "root")
    assert other.where("x = root").count() == 0


def test_leaf_fields_are_unambiguous(spark):
    rows = [(None, "a"), ("", "a"), ("-", "a"), ("1:a", ""), ("é" * 70_000, None), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select("*", merkle.leaf_of(F.col("a"), F.col("b")).alias("leaf"))

    def field(x):
        return "-" if x is None else f"{len(x.encode())}:{x}"

    assert {r["leaf"] for r in df.collect()} == {H(field(a) + field(b)) for a, b in rows}
    assert df.select("leaf").distinct().count() == len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, doc_id bigint, leaf string")
    assert merkle.prove(df, "lang", "doc_id").collect() == []
