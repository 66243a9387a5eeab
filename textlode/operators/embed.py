"""Texts to vectors, vectors to similarities, and the comparison of two embedding versions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.functions import vectors as V
from textlode.functions.keys import SEED, bucket_of, hash_key
from textlode.operators.cuts import bucket_offsets, dense_positions, keyed
from textlode.operators.scale import attach, numbered, stage, with_sides
from textlode.operators.splits import sample_rows

# Batches that one task makes at a time.
RUN_BATCHES = 4096
# Token ids of padding and of words outside the vocabulary.
PAD_ID = 0
UNKNOWN_ID = 1


def fit_encoder(df: DataFrame, text_col: str = "text", dim: int = 256) -> PipelineModel:
    """Fit the built-in encoder: hashed TF-IDF of the lower-case whitespace tokens."""
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=f"{T.BLANK}+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dim),
        IDF(inputCol="_counts", outputCol="_raw"),
    ]
    return Pipeline(stages=stages).fit(df.select(text_col).where(F.col(text_col).isNotNull()))


def embed(df: DataFrame, encoder: PipelineModel, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Add the unit-length embedding of each text; null for a text without tokens."""
    # A null text goes through as an empty one, so that one pass serves all rows.
    given = df.withColumn("_given", F.col(text_col)).withColumn(text_col, F.coalesce(text_col, F.lit("")))
    vectors = encoder.transform(given).withColumn("_values", vector_to_array("_raw"))
    unit = V.l2_normalize("_values").cast("array<float>")
    return vectors.withColumn(text_col, F.col("_given")).withColumn(out, unit).select(*df.columns, out)


def embed_query(df: DataFrame, text: str, encoder: PipelineModel) -> DataFrame:
    """One row with the embedding of one query text."""
    query = df.sparkSession.range(1).select(F.col("id").alias("query_id"), F.lit(text).alias("text"))
    return embed(query, encoder)


def embed_with(
    df: DataFrame,
    load_model: Callable[[], Callable[[list[str]], np.ndarray]],
    id_col: str = "id",
    text_col: str = "text",
    batch_size: int = 128,
) -> DataFrame:
    """(id, embedding) from any external model, in batches on the executors.

    `load_model` is called once per task and returns a function from texts to a matrix. Rows are scaled to length 1; a
    blank text or a zero vector gives null, so vectors cannot slip against their ids.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<float>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                texts = [(s or "").strip() for s in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(texts) if s]
                rows: list = [None] * len(texts)
                if full:
                    matrix = np.asarray(model([texts[i] for i in full]), dtype=np.float64)
                    lengths = np.sqrt((matrix * matrix).sum(axis=1))
                    for i, vector, length in zip(full, matrix, lengths):
                        rows[i] = (vector / length).astype(np.float32) if length > 0 else None
                vectors = pa.array(rows, type=pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=[id_col, "embedding"])

    return df.select(id_col, text_col).mapInArrow(encode, schema)


def embed_query_with(spark: SparkSession, text: str, load_model: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """One row with the embedding of one query text by an external model."""
    query = spark.range(1).select(F.col("id").alias("query_id"), F.lit(text).alias("text"))
    return query.select("query_id", "text").join(embed_with(query, load_model, "query_id"), "query_id")


def similar_to(vectors: DataFrame, query: DataFrame, vec_col: str = "embedding", out: str = "similarity") -> DataFrame:
    """Add the cosine of each vector with the one row of `query`; null where either has no vector."""
    # One vector: part of the expression, so that the vectors are scanned once and not joined.
    return vectors.withColumn(out, V.cosine(vec_col, F.lit(query.first()[vec_col]).cast("array<double>")))


def normalize_embeddings(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return df.withColumn(vec_col, V.l2_normalize(vec_col))


def hashing_model(dim: int = 16) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A model for `embed_with` that needs no training: every whitespace token adds 1 or -1 to one component.

    The first 8 hex digits of the token's md5 name the component, the next one the sign (odd is negative).
    """

    def load():
        from functools import lru_cache
        from hashlib import md5

        @lru_cache(maxsize=200_000)
        def place(token: str) -> tuple[int, int]:
            digest = md5(token.encode()).hexdigest()
            return int(digest[:8], 16) % dim, 1 - 2 * (int(digest[8], 16) % 2)

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in zip(out, texts, strict=True):
                for token in text.split():
                    at, sign = place(token)
                    row[at] += sign
            return out

        return run

    return load


def pair_scores(
    pairs: DataFrame,
    vectors: DataFrame,
    keys: list[str],
    id_col: str = "id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Add `similarity` (cosine) and `dist` (squared L2) to pairs (keys…, id_a, id_b)."""
    joined = with_sides(pairs, vectors, keys, id_col, vec_col, "_vector")
    a, b = "_vector_a", "_vector_b"
    return joined.withColumns({"similarity": V.cosine(a, b), "dist": V.squared_distance(a, b)}).drop(a, b)


def shuffled_batches(df: DataFrame, batch_size: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """(batch, id): the rows in random order, cut into batches of exactly `batch_size` rows but for the last."""
    places = dense_positions(keyed(df, id_col, None, "batch", seed))
    return places.select(F.floor(F.col("pos") / batch_size).alias("batch"), "id")


def batch_members(df: DataFrame, vec_cols: list[str], batch_size: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """(batch, members): one row per batch with its at most `batch_size` members, sorted by id. Vectors are shuffled once."""
    key = hash_key(id_col, "batch", seed)
    # A narrow pass counts the buckets of the random order. Runs of whole buckets, each with the batches that begin in its part of the
    # order, then go to one task; a bucket on the border of two runs goes to both, and a run drops the batches that are not its own.
    offsets = bucket_offsets(keyed(df, id_col, None, "batch", seed)).select("bucket", "n", "start")
    width = batch_size * RUN_BATCHES
    last = F.floor((F.col("start") + F.col("n") - 1) / width)
    runs = offsets.select("bucket", "start", F.explode(F.sequence(F.floor(F.col("start") / width), last)).alias("run"))
    firsts = runs.groupBy("run").agg(F.min("start").alias("first"))
    runs = stage(runs.join(firsts, "run").select("bucket", "run", "first"), "runs")
    unit = [V.l2_normalize(c).alias(c) for c in vec_cols]
    rows = df.select(F.col(id_col).alias("id"), key.alias("key"), bucket_of(key).alias("bucket"), *unit)
    rows = rows.join(F.broadcast(runs), "bucket").repartition("run")
    place = F.row_number().over(W.partitionBy("run").orderBy("key", "id")) - 1 + F.col("first")
    rows = rows.withColumn("batch", F.floor(place / batch_size)).where(F.floor(F.col("batch") * batch_size / width) == F.col("run"))
    member = F.struct("id", *vec_cols)
    return rows.groupBy("run", "batch").agg(F.array_sort(F.collect_list(member)).alias("members")).select("batch", "members")


def batch_similarity(df: DataFrame, batch_size: int = 16, id_col: str = "id", vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """(batch, id, ids, similarities): the rows of each batch's cosine matrix.

    A batch is as small as a training batch, so its matrix is, too.
    """
    members = batch_members(df, [vec_col], batch_size, id_col, seed)
    rows = members.select("batch", "members", F.explode("members").alias("me"))
    return rows.select(
        "batch",
        F.col("me.id").alias("id"),
        F.transform("members", lambda m: m["id"]).alias("ids"),
        F.transform("members", lambda m: V.dot(m[vec_col], F.col(f"me.{vec_col}"))).alias("similarities"),
    )


def embedding_drift(
    df: DataFrame,
    before: str,
    after: str,
    batch_size: int = 16,
    temperature: float = 2.0,
    id_col: str = "id",
    seed: int = SEED,
) -> DataFrame:
    """(batch, rows, kl): how far the similarities within each batch moved between two embedding versions.

    kl is the KL divergence of the softmax of similarity / temperature, `before` against `after`, summed over the batch
    and divided by its rows.
    """
    members = batch_members(df, [before, after], batch_size, id_col, seed)
    # At most batch_size^2 cells per batch. The rows are already together, so the sums need no further shuffle.
    rows = members.select("batch", "members", F.explode("members").alias("me"))
    cells = rows.select("batch", "me", F.explode("members").alias("other")).select(
        "batch",
        F.col("me.id").alias("id"),
        *[(V.dot(f"me.{v}", f"other.{v}") / F.lit(temperature)).alias(name) for v, name in ((before, "p"), (after, "q"))],
    )
    # With Zp = sum(exp p) and Zq = sum(exp q), the divergence of a row is
    # sum(exp(p) (p - q)) / Zp - ln Zp + ln Zq. Cosines are bounded, so exp cannot overflow.
    sums = cells.groupBy("batch", "id").agg(
        F.sum(F.exp("p")).alias("zp"),
        F.sum(F.exp("q")).alias("zq"),
        F.sum(F.exp("p") * (F.col("p") - F.col("q"))).alias("gap"),
    )
    divergence = F.col("gap") / F.col("zp") - F.log("zp") + F.log("zq")
    return sums.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.avg(divergence).alias("kl"))


def token_ids(
    df: DataFrame, max_length: int = 256, vocabulary: int | None = None, id_col: str = "id", text_col: str = "text"
) -> DataFrame:
    """(id, input_ids, attention_mask): whitespace tokens as numbers, cut or padded to max_length.

    Words get the numbers from 2 on, the most frequent first. With `vocabulary` only that many do, and all others share one number.
    """
    tokens = T.explode_words(df, F.lower(text_col))
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    table = numbered(counts, [F.desc("n"), F.asc("word")], "_place")
    if vocabulary is not None:
        table = table.where(F.col("_place") < vocabulary)
    table = table.select("word", (F.col("_place") + 2).cast("int").alias("token"))
    heads = df.select(F.col(id_col).alias("id"), F.slice(T.words(F.lower(text_col)), 1, max_length).alias("words"))
    placed = heads.select("id", F.posexplode_outer("words").alias("at", "word"))
    known = attach(placed, table, ["word"], "left")
    token = F.when(F.col("word").isNotNull(), F.coalesce("token", F.lit(UNKNOWN_ID)))
    rows = known.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(token.isNotNull(), F.struct("at", token.alias("token"))))).alias("t")
    )
    used = F.size("t")
    rest = F.lit(max_length) - used
    return rows.select(
        "id",
        F.concat(F.transform("t", lambda x: x["token"]), F.array_repeat(F.lit(PAD_ID), rest)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), rest)).alias("attention_mask"),
    )


def project_2d(
    versions: dict[str, DataFrame],
    sample: int = 2_000,
    id_col: str = "id",
    vec_col: str = "embedding",
    label_col: str = "label",
    seed: int = SEED,
) -> DataFrame:
    """(stage, id, label, x, y): a sample of each embedding version on its first two principal axes."""
    out = None
    for name, df in versions.items():
        chosen = sample_rows(df.where(F.col(vec_col).isNotNull()), sample, id_col, seed)
        chosen = chosen.select(
            F.col(id_col).alias("id"), F.col(label_col).alias("label"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("v")
        )
        model = PCA(k=2, inputCol="v", outputCol="xy").fit(chosen)
        xy = vector_to_array("xy")
        placed = model.transform(chosen).select(
            F.lit(name).alias("stage"), "id", "label", xy[0].alias("x"), xy[1].alias("y")
        )
        out = placed if out is None else out.unionByName(placed)
    return out
