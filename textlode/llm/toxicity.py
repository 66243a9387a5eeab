"""Toxicity classifier: bags of subword embeddings, averaged, under a linear softmax; trained jointly in numpy.

A text is the bag of the character n-grams of its words, hashed into a fixed number of buckets. Each bucket has an
embedding; the mean of the bag's embeddings goes through a linear layer into a softmax over the two classes. Misspelt words share
most of their n-grams with the word they come from. The fit runs over a bounded sample of labelled rows; scoring needs, per
bucket, only the difference of the classes' weights, so a text is scored in one vectorised pass in constant memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import staged

BUCKETS = 1 << 18
SHORTEST, LONGEST = 3, 6
SLICE = 1 << 20
#: Bounds of the sample that the fit sees: rows of either class, and characters in all.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 2500, 5000, 16_000_000
#: N-grams (buckets) in fewer texts of the sample get no weight; not a share, which would leave out those of smaller languages.
LEAST_TEXTS = 3
DECAY = 3e-6


def letter_table() -> np.ndarray:
    """Lower-case code of each character of the basic plane that is a letter or digit, 0 for others."""
    out = np.zeros(1 << 16, np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalnum():
            out[code] = ord(c.lower()[0])
    return out


def bags(text: str, table: np.ndarray):
    """Bucket numbers of the n-grams of a text's words, in slices. Word borders count as a character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    border = np.zeros(1, np.uint32)
    codes = np.r_[border, np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes), border]
    for at in range(0, len(codes), SLICE):
        # The windows that start in this slice; the longest one ends behind it.
        x = codes[at : at + SLICE + LONGEST - 1].astype(np.uint64)
        h = x.copy()
        inside = np.ones(len(x), bool)
        for n in range(2, LONGEST + 1):
            if len(x) < n:
                break
            m = len(x) - n + 1
            h = h[:m] * np.uint64(0x100000001B3) + x[n - 1 :]
            if n > 2:
                inside = inside[:m] & (x[n - 2 : len(x) - 1] > 0)
            if n >= SHORTEST:
                found = h[:SLICE][inside[:SLICE]] + np.uint64(n)
                yield ((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)


@dataclass
class Model:
    weight: np.ndarray  # by bucket, toxic less clean
    bias: float
    fitted: bool = True  # False if there was no row to learn from


def train(
    texts: list[str], labels: np.ndarray, dim: int = 4, epochs: int = 16, rate: float = 2.0, batch: int = 32, seed: int = 7,
    least_texts: int = LEAST_TEXTS,
) -> Model:
    """Fit embeddings and softmax together by mini-batches with per-parameter step sizes (Adagrad).

    N-grams found in fewer than `least_texts` of the texts get no weight; the steps of rare ones above that are small.
    Without both classes the model is a constant: the smoothed share of toxic rows; without any row it holds nothing to be toxic.
    """
    n, toxic = len(labels), int(labels.sum())
    if not 0 < toxic < n:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((toxic + 0.5) / (n - toxic + 0.5))), n > 0)
    table = letter_table()

    def bag(text):
        parts = [p.astype(np.int32) for p in bags(text, table)] or [np.empty(0, np.int32)]
        return np.unique(np.concatenate(parts), return_counts=True)

    texts_with = np.zeros(BUCKETS, np.int64)
    for text in texts:
        texts_with[bag(text)[0]] += 1
    common = texts_with >= least_texts
    docs = []
    for text in texts:
        ids, count = bag(text)
        own = common[ids]
        docs.append((ids[own], (count[own] / max(1, count.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.5, 0.5, (BUCKETS, dim)).astype(np.float32) / dim
    out, bias = rng.normal(0, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    emb[~common] = 0
    # Squared gradients start high enough that rare n-grams take small steps.
    g_emb, g_out, g_bias = np.full((BUCKETS, dim), 1e-4, np.float32), np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    truth = np.eye(2, dtype=np.float32)[labels]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            ids = np.concatenate([docs[r][0] for r in rows])
            share = np.concatenate([docs[r][1] for r in rows])[:, None]
            owner = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
            unique, back = np.unique(ids, return_inverse=True)
            hidden = np.zeros((len(rows), dim), np.float32)
            rows_emb = emb[unique]
            for d in range(dim):
                hidden[:, d] = np.bincount(owner, (share[:, 0] * rows_emb[back, d]), len(rows))
            logit = hidden @ out + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            d_logit = (p - truth[rows]) / len(rows)
            d_hidden = d_logit @ out.T
            d_out, d_bias = hidden.T @ d_logit, d_logit.sum(0)
            d_emb = np.empty_like(rows_emb)
            for d in range(dim):
                d_emb[:, d] = np.bincount(back, share[:, 0] * d_hidden[owner, d], len(unique))
            d_emb += DECAY * rows_emb
            g_emb[unique] += d_emb**2
            emb[unique] -= step * d_emb / np.sqrt(g_emb[unique])
            g_out += d_out**2
            out -= step * d_out / np.sqrt(g_out)
            g_bias += d_bias**2
            bias -= step * d_bias / np.sqrt(g_bias)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(texts, labels) of a bounded sample of the labelled rows, the same in every run: whole texts in order of a hash of the id.

    At most TOXIC_ROWS and CLEAN_ROWS rows of those that `docs` holds. If they have more than SAMPLE_CHARS characters, the longest texts of
    a class are left out, as few as possible; each class has its share of the characters by its rows, and what the other one leaves.
    Rows without id or label are left out; a document with both labels counts as toxic.
    """
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    given = given.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Lengths only: texts are not shuffled.
    lengths = found.select("_id", F.length("text").alias("n")).where(F.col("n") <= SAMPLE_CHARS)
    lengths = lengths.join(given, "_id").groupBy("_id").agg(F.max("y").alias("y"), F.min("n").alias("n"))
    lengths = staged(lengths.withColumn("o", F.xxhash64("_id", F.lit(1))), "labelled")
    toxic, clean = (
        lengths.where(F.col("y") == y).orderBy("o", "_id").limit(rows).toPandas().sort_values(["n", "o"]) for y, rows in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))
    )
    share = SAMPLE_CHARS * TOXIC_ROWS // (TOXIC_ROWS + CLEAN_ROWS)
    short = clean["n"][clean["n"].cumsum() <= SAMPLE_CHARS - share]
    toxic = toxic[toxic["n"].cumsum() <= SAMPLE_CHARS - int(short.sum())]
    clean = clean[clean["n"].cumsum() <= SAMPLE_CHARS - int(toxic["n"].sum())]
    sizes = pd.concat([toxic, clean])
    if sizes.empty:
        return [], np.empty(0, int)
    # At most TOXIC_ROWS + CLEAN_ROWS rows of three numbers.
    ids = docs.sparkSession.createDataFrame(sizes[["_id", "y", "n"]], "_id bigint, y int, n int")
    # The length tells rows of one id apart; of equal ones one is enough.
    rows = found.join(F.broadcast(ids.withColumnRenamed("n", "_n")), "_id").where(F.length("text") == F.col("_n"))
    rows = rows.select("_id", "y", "text").toPandas().drop_duplicates("_id").sort_values("_id")
    return rows["text"].tolist(), rows["y"].to_numpy(int)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of `docs` and the probability, 0 to 1, that the text is toxic: 0 for a model without rows. A null text counts as empty.

    A column of the score's name is replaced. The model, one number per bucket, is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weight, model.bias if model.fitted else -np.inf))

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        weight, bias = shared.value
        table = letter_table()
        scores = np.empty(len(texts))
        for i, text in enumerate(texts):
            total, n = 0.0, 0
            for ids in bags(text or "", table):
                total += float(weight[ids].sum(dtype=np.float64))
                n += len(ids)
            scores[i] = 1.0 / (1.0 + np.exp(-np.clip(bias + total / max(1, n), -40, 40))) if np.isfinite(bias) else 0.0
        return pd.Series(scores)

    return docs.withColumn(out, judge(F.col(text_col)))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents scored under the threshold, with their columns."""
    return score(docs, model, text_col, "_score").where(F.col("_score") < threshold).select(*docs.columns)
