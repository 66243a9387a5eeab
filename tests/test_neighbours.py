from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlode.operators import knn as K
from textlode.plans import evaluation

SCHEMA = "id bigint, embedding array<float>, label_id int"


def brute(queries, points, k):
    out = []
    for qid, q, _ in queries:
        ranked = sorted((float(np.cumsum((np.float32(q).astype(float) - np.float32(p).astype(float)) ** 2)[-1]), pid, lab) for pid, p, lab in points)
        out += [(qid, r + 1, pid, d, lab) for r, (d, pid, lab) in enumerate(ranked[:k])]
    return sorted(out)


def run(spark, queries, points, k=5):
    q, x = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(points, SCHEMA)
    return sorted(tuple(r) for r in K.knn(q, x, k).collect())


def random_rows(n, dim, seed, start=0):
    rng = np.random.default_rng(seed)
    return [(start + i, [float(v) for v in rng.standard_normal(dim)], int(i % 4)) for i in range(n)]


def test_equals_brute_force(spark):
    queries, points = random_rows(40, 8, 1), random_rows(300, 8, 2, 1000)
    assert run(spark, queries, points) == brute(queries, points, 5)


def test_many_blocks_give_the_same(spark, monkeypatch):
    queries, points = random_rows(60, 8, 3), random_rows(300, 8, 4, 1000)
    monkeypatch.setattr(K, "BLOCK_BYTES", 8 * 8 * 20)
    monkeypatch.setattr(K, "TILE_BYTES", 4 * 70)
    assert run(spark, queries, points) == brute(queries, points, 5)


def test_a_third_of_the_index_is_one_vector(spark):
    points = random_rows(200, 4, 5, 1000)
    points = [(i, [0.5, 0.5, 0.0, 0.0] if i % 3 == 0 else v, lab) for i, v, lab in points]
    queries = [(1, [0.5, 0.5, 0.0, 0.0], 0), (2, [0.0, 0.0, 1.0, 1.0], 0)]
    assert run(spark, queries, points, 7) == brute(queries, points, 7)


def test_small_index_gives_fewer(spark):
    queries, points = random_rows(2, 3, 6), random_rows(3, 3, 7, 10)
    assert run(spark, queries, points) == brute(queries, points, 5)


def test_equal_distances_go_by_id(spark):
    points = [(9, [1.0, 0.0], 1), (4, [1.0, 0.0], 0), (7, [-1.0, 0.0], 2)]
    got = run(spark, [(1, [0.0, 0.0], 0)], points, 2)
    assert [(r[1], r[2]) for r in got] == [(1, 4), (2, 7)]


def test_null_vectors_are_left_out(spark):
    points = [(1, [1.0, 0.0], 0), (2, None, 1)]
    assert [r[2] for r in run(spark, [(5, [1.0, 1.0], 0), (6, None, 0)], points)] == [1]


@pytest.mark.parametrize("kind", range(4))
def test_block_search_is_exact(kind):
    rng = np.random.default_rng(kind)
    for _ in range(60):
        n, m, dim, k = (int(rng.integers(1, top)) for top in (300, 30, 20, 12))
        if kind == 1:  # many ties
            points, queries = rng.integers(0, 2, (n, dim)).astype(float), rng.integers(0, 2, (m, dim)).astype(float)
        else:
            points, queries = rng.standard_normal((n, dim)), rng.standard_normal((m, dim))
        if kind == 2:  # far below single precision
            points, queries = points * 1e-25, queries * 1e-25
        if kind == 3:  # differences lost in single precision
            points, queries = points * 1e-4 + 100, queries * 1e-4 + 100
        ids = rng.permutation(n)
        q, p, d = K.nearest_in_block(queries, points, ids, k)
        exact = np.cumsum((queries[:, None, :] - points[None]) ** 2, axis=2)[:, :, -1]
        for i in range(m):
            want = np.lexsort((ids, exact[i]))[:k]
            assert (p[q == i] == want).all() and (d[q == i] == exact[i][want]).all()


def near(spark, labels):
    rows = [(1, r + 1, 100 + r, float(r), lab) for r, lab in enumerate(labels)]
    return spark.createDataFrame(rows, "query_id bigint, rank int, neighbour_id bigint, dist double, label_id int")


def test_vote_and_ranked_labels_break_ties_differently(spark):
    got = K.votes(near(spark, [2, 2, 1, 1, 0])).first()
    assert got.pred == 1 and got.labels == [2, 1, 0]
    assert {s.label_id: s.share for s in got.share} == {2: 0.4, 1: 0.4, 0: 0.2}


def test_vote_and_labels_may_use_different_k(spark):
    got = K.votes(near(spark, [2, 1, 1, 0, 0]), k_vote=1, k_labels=3).first()
    assert got.pred == 2 and got.labels == [1, 2]
    assert [(s.label_id, s.share) for s in got.share] == [(2, 1.0)]


def test_vote_follows_bincount_and_counter(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for q in range(80):
        labels = [int(x) for x in rng.integers(0, 4, 5)]
        rows += [(q, r + 1, r, float(r), lab) for r, lab in enumerate(labels)]
        want[q] = (int(np.bincount(labels).argmax()), [lab for lab, _ in Counter(labels).most_common(5)])
    df = spark.createDataFrame(rows, "query_id bigint, rank int, neighbour_id bigint, dist double, label_id int")
    assert {r.query_id: (r.pred, r.labels) for r in K.votes(df).collect()} == want


def test_few_shot_index_finds_the_new_class(spark):
    rows = [(i, [1.0, i / 100], 0, "train") for i in range(10)] + [(20 + i, [i / 100, 1.0], 1, "holdout_example") for i in range(5)]
    rows += [(40, [0.9, 0.1], 0, "test"), (41, [0.1, 0.9], 1, "holdout_test")]
    split = spark.createDataFrame(rows, SCHEMA + ", split string")
    assert evaluation.evaluate_split(split).first().accuracy == 1.0
    grown = evaluation.evaluate_few_shot(split).first()
    assert (grown.queries, grown.accuracy, grown.mrr) == (2, 1.0, 1.0)


def odd(spark, rows):
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, label_id int")


def test_vectors_of_other_lengths_raise(spark):
    index = odd(spark, [(0, [0.0, 1.0], 0), (1, [0.0, 1.0, 2.0], 0)])
    with pytest.raises(Exception, match="elements"):
        K.knn(odd(spark, [(9, [1.0, 1.0], 0)]), index).collect()
    with pytest.raises(Exception, match="elements"):
        K.knn(odd(spark, [(9, [1.0], 0)]), index.where("id = 0")).collect()


def test_unusable_vectors_take_no_part_and_are_counted(spark):
    index = odd(spark, [(i, [float(i), 0.0], i % 2) for i in range(6)] + [(6, None, 0), (7, [None, 1.0], 0), (8, [float("nan"), 0.0], 0)])
    queries = odd(spark, [(20, [0.1, 0.0], 0), (21, None, 1), (22, [float("nan"), 1.0], 0), (23, [1.1, 0.0], 1)])
    assert {r.query_id for r in K.knn(queries, index, 2).collect()} == {20, 23}
    scored = evaluation.score_queries(queries, index, 1, 1)
    row = evaluation.evaluate(scored).first()
    assert (row.queries, row.unscored, row.accuracy, row.topk_accuracy) == (4, 2, 0.5, 0.5)


def test_workers_need_no_copy_of_the_package(tmp_path):
    """From another folder: only the driver's path knows the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
assert entry.queries()["j1_knn"](spark, "/root/testdata/sf0.001").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def clustered(n, groups, seed, start=0, dim=6, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).standard_normal((groups, dim)) * 10
    at = rng.integers(0, groups, n)
    return [(start + i, [float(np.float32(v)) for v in centres[g] + spread * rng.standard_normal(dim)], int(g % 4)) for i, g in enumerate(at)]


def test_clustered_queries_meet_few_cells_and_points_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAST_BLOCK", 40)
    queries, points = clustered(200, 30, 1), clustered(3000, 30, 2, 1000)
    q, x = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(points, SCHEMA).repartition(5)
    ready, asked, n, dim = K._sides(q, x, "id", "embedding", "label_id")
    cells = K.cells_of(ready, 5, n, dim)
    assert len(cells.pivots) > 30
    assert cells.points.count() == len(points)
    met = cells.routes(asked).groupBy("query_id").count()
    total, blocks = met.agg(F.sum("count")).first()[0], int(cells.blocks.sum())
    assert met.count() == len(queries)
    # A tenth of the meetings of all queries with all blocks, at most.
    assert total * 10 < len(queries) * blocks
    assert run(spark, queries, points) == brute(queries, points, 5)


@pytest.mark.parametrize("kind", range(4))
def test_cells_lose_no_neighbour(spark, monkeypatch, kind):
    """Unclustered, clustered, mostly copies, far from 0: with cells smaller than k and blocks smaller than cells."""
    monkeypatch.setattr(K, "LEAST_BLOCK", 7)
    queries, points = random_rows(50, 5, 20 + kind), random_rows(400, 5, 30 + kind, 1000)
    if kind == 1:
        queries, points = clustered(50, 9, 5, dim=5), clustered(400, 9, 6, 1000, dim=5)
    if kind == 2:
        points = [(i, [1.0, 2.0, 3.0, 4.0, 5.0] if i % 4 else v, lab) for i, v, lab in points]
    if kind == 3:
        points = [(i, [float(np.float32(x + 1000)) for x in v], lab) for i, v, lab in points]
    for cell_rows in (3, 60):
        q, x = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(points, SCHEMA)
        got = sorted(tuple(r) for r in K.knn(q, x, 6, cell_rows=cell_rows).collect())
        assert got == brute(queries, points, 6)


def test_probing_all_cells_is_exact_and_recall_says_so(spark):
    queries, points = clustered(60, 12, 3), clustered(900, 12, 4, 1000)
    q, x = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(points, SCHEMA)
    centres = K.train_cells(x, 12)
    every = K.knn_probe(q, x, centres, len(centres))
    assert sorted(tuple(r) for r in every.collect()) == brute(queries, points, 5)
    exact = K.knn(q, x)
    assert K.recall(every, exact).first().recall == 1.0
    few = K.recall(K.knn_probe(q, x, centres, 2), exact).first()
    assert few.queries == 60 and few.neighbours == 300 and few.recall >= 0.9
    assert K.recall(every.where("query_id < 0"), exact).first().recall == 0.0


def test_empty_sides(spark):
    rows = spark.createDataFrame(random_rows(5, 3, 1), SCHEMA)
    assert K.knn(rows.where("false"), rows).collect() == []
    assert K.knn(rows, rows.where("false")).collect() == []


def traced_peak(run):
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_routing_a_batch_takes_bounded_memory(spark, monkeypatch):
    """However many cells and queries: a batch of queries that meet all blocks is routed in slices, each as large as a tile."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)], 0) for i in range(400)], "neighbour_id bigint, point array<double>, label_id int")
    pivots = rng.normal(size=(200, 3))
    cells = K.Cells(points, pivots, 5, 1, 400)
    cells.kth = np.full(200, np.inf)
    asked = spark.createDataFrame([], "query_id bigint, query array<double>")
    taken = []
    monkeypatch.setattr(type(asked), "mapInArrow", lambda self, f, schema: taken.append(f))
    cells.routes(asked)
    monkeypatch.setattr(K, "TILE_BYTES", 1 << 20)
    monkeypatch.setattr(K, "ROUTED_ROWS", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(rng.normal(size=(4000, 3)).tolist())], names=["query_id", "query"])
    met = []
    peak = traced_peak(lambda: met.extend(len(out) for out in taken[0](iter([batch]))))
    assert sum(met) == 4000 * int(cells.blocks.sum()) >= 1_600_000
    assert peak < 24 << 20
    first = pa.Table.from_batches(list(taken[0](iter([batch.slice(0, 50)]))))
    pairs = set(zip(first.column(0).to_pylist(), first.column(1).to_pylist()))
    assert pairs == {(block, q) for block in range(int(cells.blocks.sum())) for q in range(50)} and first.num_rows == len(pairs)
