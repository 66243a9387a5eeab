"""Nearest neighbours, exact and approximate, and the votes built on them."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.pandas.types import to_arrow_schema

from textlode.operators.scale import stage

# Memory for one block of vectors and for one tile of distances in a task.
BLOCK_BYTES = 64 * 1024 * 1024
TILE_BYTES = 16 * 1024 * 1024
# Points per run whose smallest distance is looked at first.
RUN = 64
# Queries that meet an index block at once, and rows of queries sent to blocks at a time.
QUERY_ROWS = 4096
ROUTED_ROWS = 10_000
# Rows of a small index block, blocks a larger index is cut into at least, and tasks they are dealt to at most.
LEAST_BLOCK, LEAST_BLOCKS, MOST_TASKS = 2048, 64, 8192
# Most pivots, whose vectors every task holds, and rows a coarse quantiser is trained on.
MOST_PIVOTS = 1024
TRAINED_ROWS = 100_000


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column to a double matrix without going through Python objects."""
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(rows), -1)


def slices(column: pa.Array, width: int):
    """A list column in matrices of so many rows that a table of `width` numbers for each row is no larger than a tile; where each begins."""
    step = max(1, TILE_BYTES // (8 * max(width, 1)))
    for at in range(0, len(column), step):
        yield at, matrix(pa.chunked_array([column.slice(at, step)]))


def nearest_in_block(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int):
    """(query row, point row, squared distance) of each query's k nearest points, ties by id.

    A single-precision matrix product gives rough distances. The k-th smallest minimum over runs of points
    bounds the k-th distance, and every point within that bound and the bounded rounding error is then measured by
    direct difference in double, summed from the first element to the last. Points are sorted by id, so ties
    go to the smaller id.
    """
    order = np.arange(len(ids))
    if (ids[1:] < ids[:-1]).any():
        order = np.argsort(ids, kind="stable")
        points = points[order]
    n, dim = points.shape
    k = min(k, n)
    run = max(1, min(RUN, n // k))  # at least k runs
    # Scaled to norms of at most 1, so the error bound is absolute and nothing overflows.
    norms = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (queries, points)]
    scale = max(float(x.max()) for x in norms) or 1.0
    error = 4 * (dim + 8) * float(np.finfo(np.float32).eps)
    # |x|^2 - 2qx as one product: the norms are a further row, and padding is out of reach.
    rough_points = np.zeros((dim + 1, -(-n // run) * run), dtype=np.float32)
    # In place, as a copy in double would be the largest of all.
    np.multiply(points.T, -2 / scale, out=rough_points[:dim, :n], casting="same_kind")
    rough_points[dim, :n] = (norms[1] / scale) ** 2
    rough_points[dim, n:] = 1e30
    tile = max(1, TILE_BYTES // (4 * rough_points.shape[1]))
    found_q, found_p, found_d = [], [], []
    for begin in range(0, len(queries), tile):
        block = queries[begin : begin + tile]
        rough_queries = np.ones((len(block), dim + 1), dtype=np.float32)
        rough_queries[:, :dim] = block / scale
        rough = (rough_queries @ rough_points).reshape(len(block), -1, run)
        lowest = rough.min(axis=2)
        bound = (np.partition(lowest, k - 1, axis=1)[:, k - 1] + np.float32(error))[:, None]
        run_q, run_p = np.nonzero(lowest <= bound)
        hit, offset = np.nonzero(rough[run_q, run_p] <= bound[run_q])
        near_q, near_p = run_q[hit], run_p[hit] * run + offset
        exact = np.empty(len(near_q))
        step = max(1, TILE_BYTES // (8 * dim))
        for at in range(0, len(near_q), step):
            gap = block[near_q[at : at + step]] - points[near_p[at : at + step]]
            exact[at : at + step] = np.cumsum(gap * gap, axis=1)[:, -1]
        by_rank = np.lexsort((near_p, exact, near_q))
        near_q, near_p, exact = near_q[by_rank], near_p[by_rank], exact[by_rank]
        first = np.searchsorted(near_q, near_q, side="left")
        keep = np.arange(len(near_q)) - first < k
        found_q.append(near_q[keep] + begin)
        found_p.append(order[near_p[keep]])
        found_d.append(exact[keep])
    return np.concatenate(found_q), np.concatenate(found_p), np.concatenate(found_d)


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices, to about 1e-7 of the largest norm."""
    squares = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2 * (left @ right.T)
    return np.sqrt(np.maximum(squares, 0))


def _vectors(frame: DataFrame) -> np.ndarray:
    """A one-column frame of vectors, of a bounded number of rows, as a matrix."""
    rows = frame.toArrow().column(0)
    return matrix(rows) if len(rows) else np.empty((0, 0))


def _usable(vec_col: str):
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite, F.lit(False))


class Cells:
    """An index cut into cells, each of the points nearest to one pivot, and the cells into blocks of bounded size.

    points: (block, neighbour_id, point, label_id). Of each cell its blocks are known, the least and the largest distance of its
    points to the pivot, and the k-th least.
    """

    def __init__(self, points: DataFrame, pivots: np.ndarray, k: int, block_rows: int, n: int):
        self.pivots, self.k = pivots, k
        if len(pivots) < 2:
            blocks = max(1, math.ceil(n / block_rows))
            block = F.pmod(F.xxhash64("neighbour_id"), F.lit(blocks)).cast("int")
            self.first, self.blocks = np.array([0]), np.array([blocks])
            self.near, self.far, self.kth = np.zeros(1), np.full(1, np.inf), np.full(1, np.inf)
            self.points = points.withColumn("block", block)
            return
        placed = stage(self._placed(points), "cells")
        # Few rows a cell and task survive before the shuffle, as the window keeps the first k only.
        by_radius = W.partitionBy("cell").orderBy("radius")
        kth = placed.select("cell", "radius", F.row_number().over(by_radius).alias("at")).where(F.col("at") <= k)
        kth = kth.groupBy("cell").agg(F.max(F.when(F.col("at") == k, F.col("radius"))).alias("kth"))
        facts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far"))
        # At most one row per pivot.
        rows = {r["cell"]: r for r in facts.join(kth, "cell").collect()}
        cells = range(len(pivots))
        self.blocks = np.array([math.ceil(rows[c]["n"] / block_rows) if c in rows else 0 for c in cells])
        self.first = np.cumsum(self.blocks) - self.blocks
        self.near = np.array([rows[c]["near"] if c in rows else np.inf for c in cells])
        self.far = np.array([rows[c]["far"] if c in rows else -np.inf for c in cells])
        self.kth = np.array([rows[c]["kth"] if c in rows and rows[c]["kth"] is not None else np.inf for c in cells])
        table = [(c, int(self.first[c]), int(self.blocks[c])) for c in rows]
        known = points.sparkSession.createDataFrame(table, "cell int, first int, blocks int")
        block = F.col("first") + F.pmod(F.xxhash64("neighbour_id"), F.col("blocks")).cast("int")
        self.points = placed.join(known, "cell").withColumn("block", block).select("block", "neighbour_id", "point", "label_id")

    def _placed(self, points: DataFrame) -> DataFrame:
        schema = t.StructType([*points.schema.fields, t.StructField("cell", t.IntegerType()), t.StructField("radius", t.DoubleType())])
        shared = points.sparkSession.sparkContext.broadcast(self.pivots)

        def run(batches):
            for batch in batches:
                cell, radius = np.empty(len(batch), int), np.empty(len(batch))
                for at, vectors in slices(batch.column("point"), len(shared.value)):
                    gaps = _distances(vectors, shared.value)
                    cell[at : at + len(vectors)], radius[at : at + len(vectors)] = gaps.argmin(1), gaps.min(1)
                columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(radius, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return points.mapInArrow(run, schema)

    def routes(self, asked: DataFrame, probes: int | None = None) -> DataFrame:
        """(block, query_id, query): the blocks each query has to meet.

        A query's k-th distance is at most its distance to a pivot and the k-th radius of that cell; the least such sum is its bound. No point of a
        cell is nearer than the triangle inequality says, from the radii and from the pivot of the query's own cell: cells that are
        further than the bound are left out. With `probes`, only the cells of so many nearest pivots are met.
        """
        if len(self.pivots) < 2:
            every = F.explode(F.sequence(F.lit(0), F.lit(int(self.blocks[0]) - 1)))
            return asked.select(every.alias("block"), "query_id", "query")
        schema = t.StructType([t.StructField("block", t.IntegerType()), asked.schema["query_id"], asked.schema["query"]])
        shared = asked.sparkSession.sparkContext.broadcast((self.pivots, self.first, self.blocks, self.near, self.far, self.kth))

        def wanted(gaps, scale, near, far, kth, blocks):
            if probes is not None:
                gaps = np.where(blocks > 0, gaps, np.inf)
                at = np.argsort(gaps, axis=1, kind="stable")[:, :probes]
                out = np.zeros(gaps.shape, bool)
                np.put_along_axis(out, at, True, axis=1)
                return out
            slack = 1e-6 * scale
            bound = (gaps + kth).min(1, keepdims=True) + slack
            least = np.maximum(np.maximum(gaps - far, near - gaps), (gaps - gaps.min(1, keepdims=True)) / 2)
            # What cannot be compared is met.
            return ~(least > bound + slack)

        def run(batches):
            pivots, first, blocks, near, far, kth = shared.value
            widest = float(np.sqrt((pivots * pivots).sum(1)).max())
            for batch in batches:
                for start, vectors in slices(batch.column("query"), max(len(pivots), int(blocks.sum()))):
                    scale = widest + np.sqrt((vectors * vectors).sum(1))[:, None]
                    row, cell = np.nonzero(wanted(_distances(vectors, pivots), scale, near, far, kth, blocks) & (blocks > 0))
                    # All blocks of a cell, one after the other.
                    times = blocks[cell]
                    block = np.repeat(first[cell] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    row = np.repeat(row + start, times)
                    for at in range(0, len(row), ROUTED_ROWS):
                        part = batch.take(pa.array(row[at : at + ROUTED_ROWS]))
                        columns = [pa.array(block[at : at + ROUTED_ROWS], pa.int32()), part.column("query_id"), part.column("query")]
                        yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))

        return asked.select("query_id", "query").mapInArrow(run, schema)


def _meet(points: DataFrame, routes: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query_id, rank, neighbour_id, dist, label_id): the k best points of the blocks that each query meets.

    Points and queries of a block come to one task, the points first: a task holds one block and a tile of queries. No point is copied.
    """
    kinds = {c: points.schema[c].dataType for c in ("neighbour_id", "point", "label_id")} | {
        c: routes.schema[c].dataType for c in ("query_id", "query")
    }
    nothing = {c: F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()}
    left = points.select("block", F.lit(0).alias("side"), "neighbour_id", "point", "label_id", nothing["query_id"], nothing["query"])
    right = routes.select("block", F.lit(1).alias("side"), nothing["neighbour_id"], nothing["point"], nothing["label_id"], "query_id", "query")
    schema = t.StructType(
        [
            t.StructField("query_id", kinds["query_id"]),
            t.StructField("neighbour_id", kinds["neighbour_id"]),
            t.StructField("dist", t.DoubleType()),
            t.StructField("label_id", kinds["label_id"]),
        ]
    )
    arrow = to_arrow_schema(schema)

    def sorted_block(index: list[pa.RecordBatch]):
        """Ids, points and labels of a block by id; its batches are let go."""
        x = pa.Table.from_batches(index)
        index.clear()
        x = x.take(np.argsort(x["neighbour_id"].to_numpy(), kind="stable"))
        return x["neighbour_id"].combine_chunks(), matrix(x["point"]), x["label_id"].combine_chunks()

    def found(block, queries: list[pa.RecordBatch]):
        if block is None or not queries:
            return
        ids, points, labels = block
        asked = pa.Table.from_batches(queries)
        q, p, d = nearest_in_block(matrix(asked["query"]), points, ids.to_numpy(zero_copy_only=False), k)
        columns = [asked["query_id"].take(q), ids.take(p), pa.array(d), labels.take(p)]
        yield from pa.table(columns, names=arrow.names).cast(arrow).to_batches()

    def run(batches):
        block, index, points, queries, held = None, [], None, [], 0
        for batch in batches:
            name = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if name[a] != block:
                    yield from found(points, queries)
                    block, points, held = name[a], None, 0
                    index.clear()
                    queries.clear()
                part = batch.slice(a, b - a)
                points_here = int((part.column("side").to_numpy() == 0).sum())
                if points_here:
                    index.append(part.slice(0, points_here).select(["neighbour_id", "point", "label_id"]))
                if points_here < len(part):
                    # The points of a block come before its queries.
                    points = sorted_block(index) if index else points
                    queries.append(part.slice(points_here).select(["query_id", "query"]))
                    held += len(part) - points_here
                if held >= QUERY_ROWS:
                    yield from found(points, queries)
                    held = 0
                    queries.clear()
        yield from found(points, queries)

    together = left.unionByName(right).repartition(min(blocks, MOST_TASKS), "block").sortWithinPartitions("block", "side")
    best = together.mapInArrow(run, schema)
    by_distance = W.partitionBy("query_id").orderBy("dist", "neighbour_id")
    ranked = best.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbour_id", "dist", "label_id")


def _sides(queries: DataFrame, index: DataFrame, id_col: str, vec_col: str, label_col: str):
    """Points and queries with usable vectors, written once, as the encoder or split behind them is read several times; their sizes."""
    points = index.where(_usable(vec_col)).select(
        F.col(id_col).alias("neighbour_id"), F.col(vec_col).alias("point"), F.col(label_col).alias("label_id")
    )
    asked = queries.where(_usable(vec_col)).select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query"))
    points, asked = stage(points, "points"), stage(asked, "queries")
    counts = [F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most")]
    sizes = points.select(F.lit(0).alias("side"), F.size("point").alias("size")).unionAll(asked.select(F.lit(1), F.size("query")))
    found = {r["side"]: r for r in sizes.groupBy("side").agg(*counts).collect()}
    lengths = sorted({x for r in found.values() for x in (r["least"], r["most"])})
    if len(lengths) > 1 and 0 in found:
        raise ValueError(f"vectors of {lengths[0]} and {lengths[-1]} elements")
    return points, asked, found[0]["n"] if 0 in found else 0, lengths[0] if lengths else 1


def _distinct(points: DataFrame, k: int) -> DataFrame:
    """Of equal vectors only the k smallest ids can be among the k nearest: this bounds the ties at the k-th place.

    It prunes before its shuffle. The digest comes first, as comparing whole vectors is slow.
    """
    copies = W.partitionBy(F.xxhash64("point"), "point").orderBy("neighbour_id")
    return points.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")


def _block_rows(n: int, dim: int) -> int:
    """Rows of an index block: small enough for a task, and so that a small index still gives some tasks work."""
    return max(1, min(BLOCK_BYTES // (8 * max(dim, 1)), max(LEAST_BLOCK, n // LEAST_BLOCKS)))


def cells_of(index: DataFrame, k: int, n: int, dim: int, cell_rows: int | None = None) -> Cells:
    """An index (neighbour_id, point, label_id) of n rows cut into cells around pivots that are drawn from it by a hash."""
    rows = _block_rows(n, dim)
    count = min(MOST_PIVOTS, math.ceil(n / (cell_rows or rows)))
    pivots = np.empty((0, dim))
    if count > 1:
        pivots = np.unique(_vectors(index.orderBy(F.xxhash64("neighbour_id", F.lit(7)), "neighbour_id").limit(count).select("point")), axis=0)
    return Cells(_distinct(index, k), pivots, k, rows, n)


def knn(
    queries: DataFrame,
    index: DataFrame,
    k: int = 5,
    id_col: str = "id",
    vec_col: str = "embedding",
    label_col: str = "label_id",
    cell_rows: int | None = None,
) -> DataFrame:
    """(query_id, rank, neighbour_id, dist, label_id): the k nearest index rows of each query, by squared L2 distance.

    Ties go to the smaller neighbour id; an index of fewer than k rows gives fewer neighbours. Vectors that are null or hold
    null, NaN or infinity take no part; vectors of different lengths raise.

    The index is cut into cells around pivots, about one per `cell_rows` rows; every point goes to one task. A query goes to the
    cells that the triangle inequality does not rule out, and meets each as one matrix product that only gives its k best, so no set of all pairs
    is formed. How much that saves depends on the vectors: where they lie in groups, a query meets few cells; where all are about equally
    far from each other, an exact search has to look at all of them. The final merge is a top-k window, which prunes before its shuffle.
    """
    points, asked, n, dim = _sides(queries, index, id_col, vec_col, label_col)
    cells = cells_of(points, k, n, dim, cell_rows)
    return _meet(cells.points, cells.routes(asked), k, int(cells.blocks.sum()))


def train_cells(index: DataFrame, cells: int, vec_col: str = "embedding", rows: int = TRAINED_ROWS, seed: int = 42) -> np.ndarray:
    """Centres of a coarse quantiser: k-means over the first `rows` usable vectors in order of a hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chosen = index.where(_usable(vec_col)).select(F.col(vec_col).cast("array<double>").alias("v"))
    chosen = stage(chosen.orderBy(F.xxhash64("v", F.lit(seed))).limit(rows), "trained")
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(chosen.select(array_to_vector("v").alias("f")))
    return np.unique(np.array(model.clusterCenters()), axis=0)


def knn_probe(
    queries: DataFrame,
    index: DataFrame,
    centres: np.ndarray,
    probes: int,
    k: int = 5,
    id_col: str = "id",
    vec_col: str = "embedding",
    label_col: str = "label_id",
) -> DataFrame:
    """The columns of `knn`, approximately: each query meets only the cells of the `probes` centres nearest to it.

    All index rows are in some cell, and the distances given are exact. With as many probes as centres the result is that of `knn`.
    """
    points, asked, n, dim = _sides(queries, index, id_col, vec_col, label_col)
    cells = Cells(_distinct(points, k), centres, k, _block_rows(n, dim), n)
    return _meet(cells.points, cells.routes(asked, probes), k, max(1, int(cells.blocks.sum())))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, neighbours, found, recall): the share of the exact neighbours that are among those found.

    Neighbours at the distance of a query's last one count as equals, so ties do not matter.
    """
    last = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("last"))
    hits = found.join(last.select("query_id", "last"), "query_id").where("dist <= last").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    hit = F.least("n", F.coalesce("hits", F.lit(0)))
    return last.join(hits, "query_id", "left").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("n").alias("neighbours"), F.sum(hit).alias("found"), (F.sum(hit) / F.sum("n")).alias("recall")
    )


def votes(neighbours: DataFrame, k_vote: int = 5, k_labels: int = 5) -> DataFrame:
    """(query_id, pred, labels, share): everything read off the neighbours of a query, in one aggregate.

    pred: most frequent label of the k_vote nearest, ties to the smallest label id.
    labels: the distinct labels of the k_labels nearest by count, ties to the one met first.
    share: (label_id, fraction) of the votes.
    """
    per_label = neighbours.groupBy("query_id", "label_id").agg(
        F.count_if(F.col("rank") <= k_vote).alias("votes"),
        F.count_if(F.col("rank") <= k_labels).alias("seen"),
        F.min("rank").alias("first"),
    )
    entry = F.struct((-F.col("seen")).alias("seen"), "first", "label_id")
    per_query = per_label.groupBy("query_id").agg(
        F.min(F.struct((-F.col("votes")).alias("votes"), "label_id")).alias("_winner"),
        F.array_sort(F.collect_list(F.when(F.col("seen") > 0, entry))).alias("_entries"),  # at most k_labels
        F.sum("votes").alias("_total"),
        F.collect_list(F.when(F.col("votes") > 0, F.struct("label_id", "votes"))).alias("_votes"),  # at most k_vote
    )
    return per_query.select(
        "query_id",
        F.col("_winner.label_id").alias("pred"),
        F.transform("_entries", lambda e: e["label_id"]).alias("labels"),
        F.transform(
            "_votes", lambda v: F.struct(v["label_id"].alias("label_id"), (v["votes"] / F.col("_total")).alias("share"))
        ).alias("share"),
    )


def majority_vote(neighbours: DataFrame, k: int = 5) -> DataFrame:
    return votes(neighbours, k, k).select("query_id", "pred")


def ranked_labels(neighbours: DataFrame, k: int = 5) -> DataFrame:
    return votes(neighbours, k, k).select("query_id", "labels")


def grow_index(index: DataFrame, examples: DataFrame) -> DataFrame:
    """Index with the few-shot examples appended."""
    return index.unionByName(examples)
