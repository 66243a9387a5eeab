"""Exact top-k search by distributed histogram selection.

Vectors are turned into integers, so scores are exact. Queries go through the candidates in blocks of QUERY_BLOCK vectors. For each
block every task scores its candidates and counts the scores in histograms; the sum of the histograms tells in which bin
each query's kth highest score lies, and the next round divides that bin, until bins are one score wide. A last pass keeps
the candidates above the kth score, and of those equal to it the smallest ids. A task reports only its highest bins that
hold k candidates of its own, and at most k ties, so what it returns does not depend on how many rows it has read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
BINS = 1024
QUERY_BLOCK = 2048
CHUNK = 4096
#: Scores below the first are exact in double precision, differences of scores below the second in 64-bit integers.
EXACT_DOUBLES, EXACT_INTEGERS = 2**52, 2**61


def as_integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * x) of each component; vectors that are null or hold null or non-finite components are left out."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    bad = F.exists(
        F.col(vec_col),
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    usable = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()
    return vectors.where(usable).where(~bad).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def _scores(batches, ids: np.ndarray, block: np.ndarray):
    """Candidate ids and the score matrix (queries, candidates) of pieces of the input; a query's own rows are under every score.

    The block says how scores are made: in double precision, which is exact for integers below 2 ** 53, or in 64-bit integers.
    """
    never = -np.inf if block.dtype == float else np.iinfo(np.int64).min // 2
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            size = part["v"].map(len).to_numpy()
            if (size != block.shape[1]).any():
                raise ValueError(f"vectors of {block.shape[1]} and {size[size != block.shape[1]][0]} components")
            own = part["id"].to_numpy(np.int64)
            scores = block @ np.stack(part["v"].to_numpy()).astype(block.dtype).T
            scores[ids[:, None] == own[None, :]] = never
            yield own, scores


def _histograms(candidates: DataFrame, ids, block, low, width, k: int) -> pd.DataFrame:
    """(q, bin, n): counts of scores in [low, low + BINS * width) of each query, bins numbered from the highest scores down.

    Bin -1 counts the scores above. Of each task only the bins that hold its own k highest.
    """
    shared = candidates.sparkSession.sparkContext.broadcast((ids, block, low, width))

    def run(batches):
        ids, block, low, width = shared.value
        total = np.zeros((len(ids), BINS + 1), np.int64)
        line = (np.arange(len(ids)) * (BINS + 1))[:, None]
        for _, scores in _scores(batches, ids, block):
            at = BINS - 1 - (scores - low[:, None]) // width[:, None]
            inside = at < BINS
            flat = (np.maximum(at, -1) + 1 + line)[inside].astype(np.int64)
            total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        need = total.cumsum(1) - total < k
        q, at = np.nonzero((total > 0) & need)
        yield pd.DataFrame({"q": q, "bin": at - 1, "n": total[q, at]})

    found = candidates.mapInPandas(run, "q bigint, bin bigint, n bigint")
    return found.groupBy("q", "bin").agg(F.sum("n").alias("n")).where("n > 0")


def _kth_bins(histogram: DataFrame, k: int) -> pd.DataFrame:
    """Of each query, the bin that holds its kth highest score; one row per query that has k."""
    down = Window.partitionBy("q").orderBy("bin")
    seen = histogram.withColumn("seen", F.sum("n").over(down))
    return seen.where("seen >= %d" % k).groupBy("q").agg(F.min("bin").alias("bin")).toPandas()


def _search_block(candidates: DataFrame, ids: np.ndarray, block: np.ndarray, bound: int, k: int) -> DataFrame:
    """The k best candidates of one block of queries. `bound`: no score is further from 0."""
    low = np.full(len(ids), -bound, block.dtype)
    width = np.full(len(ids), max(1, -(-(2 * bound + 1) // BINS)), block.dtype)
    short = np.zeros(len(ids), bool)
    first = True
    while first or (width > 1).any():
        if not first:
            # Divide the bin that holds the kth score.
            width = np.maximum(1, -(-width // BINS))
        found = _kth_bins(_histograms(candidates, ids, block, low, width, k), k)
        if first:
            short[:] = True
            short[found["q"].to_numpy()] = False
        q = found["q"].to_numpy()
        low[q] = low[q] + (BINS - 1 - found["bin"].to_numpy()) * width[q]
        first = False
    # Now `low` is the kth score; queries with fewer than k candidates take all.
    low[short] = -bound
    shared = candidates.sparkSession.sparkContext.broadcast((ids, block, low))

    def run(batches):
        ids, block, low = shared.value
        best: list[pd.DataFrame] = []
        n = 0
        for own, scores in _scores(batches, ids, block):
            q, c = np.nonzero(scores >= low[:, None])
            best.append(pd.DataFrame({"q": q, "vec_id": own[c], "score": scores[q, c].astype(np.int64)}))
            n += len(q)
            if n > 4 * k * len(ids):
                best, n = [kept(best)], 0
        if best:
            out = kept(best)
            yield pd.DataFrame({"query_id": ids[out["q"].to_numpy()], "vec_id": out["vec_id"], "score": out["score"]})

    def kept(parts):
        every = pd.concat(parts).sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return every[every.groupby("q").cumcount() < k]

    return candidates.mapInPandas(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k candidates of the highest inner product, ties to the smaller id.

    Both tables are (id, v) with v an array of integers of one length; another length raises. A candidate with the query's id takes
    no part in that query. A query with fewer than k candidates gets all. Repeated candidate rows count as often as they
    occur; a repeated query row is one query (the one whose vector sorts first). Empty tables give an empty table. Scores are exact: beyond what
    doubles hold they are computed in 64-bit integers, and vectors so large that these may not do raise.
    Blocks of queries, at most `query_block` vectors at a time, pass through the driver; candidates are never moved.
    """
    from textlode.llm.common import staged

    spark = candidates.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    candidates = staged(candidates, "vectors")
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    # Largest sum of squares, rounded up: by Cauchy and Schwarz no score is further from 0.
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bound = max(candidates.agg(F.max(squares)).first()[0] or 0.0, queries.agg(F.max(squares)).first()[0] or 0.0)
    bound = int(bound * (1 + 1e-9)) + 1
    if bound >= EXACT_INTEGERS:
        raise ValueError("scores of these vectors may not fit 64-bit integers")
    kind = float if bound < EXACT_DOUBLES else np.int64
    number = queries.count()
    out = []
    blocks = -(-number // query_block)
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, blocks)))
    for i in range(blocks):
        # Blocks are dealt by a hash of the id, a few rows around query_block each.
        rows = queries.where(part == i).orderBy("id").toPandas()
        if rows.empty:
            continue
        block = np.stack(rows["v"].to_numpy()).astype(kind)
        out.append(_search_block(candidates, rows["id"].to_numpy(np.int64), block, bound, k))
    if not out:
        return spark.createDataFrame([], schema)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
