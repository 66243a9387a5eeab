"""TF-IDF in relational form (id, term, weight) and the cosine of text pairs.

Weights follow the usual smooth form: raw count * (ln((1 + N) / (1 + df)) + 1), each document scaled to
length 1. Terms are lower-case runs of 2 or more word characters.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators.scale import stage

# Terms whose idf every task holds, and pairs of a document and a term that a task counts.
FREQUENT = 1 << 17
TASK_PAIRS = 2_000_000


def inverse_frequency(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, idf) over all documents."""
    per_term = (
        df.select(F.explode(F.array_distinct(T.terms(text_col))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    documents = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_term.withColumn("idf", F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0)


def frequent(idf: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(term, idf) of the most frequent terms, FREQUENT at most, and of the others; how often a term is in a document in all."""
    level = F.floor(F.log2("df") * 4)
    # A row for each quarter of a power of 2.
    levels = idf.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("df").alias("pairs")).collect()
    least, held = float("inf"), 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["level"]
    terms = idf.withColumn("_frequent", level >= F.lit(float(least)))
    common, rest = terms.where("_frequent"), terms.where("not _frequent")
    return common.select("term", "idf"), rest.select("term", "idf"), sum(r["pairs"] for r in levels)


def vectors(docs: DataFrame, idf: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, length, terms) of the documents with a term: the length of the vector and its sorted (term, raw, tf) before scaling.

    `idf` is staged. The texts are shuffled once by id; counting terms and scaling documents then stay in place. Frequent terms, most of
    what is in any text, are a bounded table that every task holds. Only of the others each document asks for the idf, in
    rows that meet the vocabulary by term and then travel with the texts.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    common, rest, pairs = frequent(idf)
    asked = texts.select("id", F.explode(F.array_distinct(T.terms("text"))).alias("term"))
    asked = asked.join(F.broadcast(common.select("term")), "term", "left_anti")
    answers = asked.join(rest, "term").select("id", F.lit(None).cast("string").alias("text"), F.array("term").alias("answer"), "idf")
    both = texts.select("*", F.lit(None).cast("array<string>").alias("answer"), F.lit(None).cast("double").alias("idf")).unionByName(answers)
    # So many tasks that the terms of each fit its memory.
    both = both.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS)), "id")
    rows = both.select("id", "idf", F.col("answer").isNull().cast("bigint").alias("n"), F.explode(F.coalesce("answer", T.terms("text"))).alias("term"))
    counts = rows.groupBy("id", "term").agg(F.sum("n").alias("tf"), F.max("idf").alias("idf"))
    found = counts.join(F.broadcast(common.withColumnRenamed("idf", "_common")), "term", "left").withColumn("idf", F.coalesce("_common", "idf"))
    raw = found.where("idf IS NOT NULL").select("id", "term", (F.col("tf") * F.col("idf")).alias("raw"), F.col("tf").cast("int").alias("tf"))
    # One document's terms: as large as the document, which already is one value.
    per_doc = raw.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "raw", "tf"))).alias("terms"))
    length = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["raw"] * t["raw"]))
    return per_doc.select("id", length.alias("length"), "terms")


def exploded(found: DataFrame, *keep: str) -> DataFrame:
    """(keep…, term, weight) of `vectors`, each scaled to length 1."""
    rows = found.select(*keep, "length", F.explode("terms").alias("t"))
    return rows.select(*keep, "t.term", (F.col("t.raw") / F.col("length")).alias("weight"))


def weights(docs: DataFrame, idf: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, weight) of the documents, each scaled to length 1."""
    return exploded(vectors(docs, idf, id_col, text_col), "id")


def tfidf(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, weight) of the whole corpus."""
    return weights(df, stage(inverse_frequency(df, text_col), "idf"), id_col, text_col)


def inner_products(words_a: pd.Series, tf_a: pd.Series, words_b: pd.Series, tf_b: pd.Series, raw_b: pd.Series) -> pd.Series:
    """Inner products of vectors before scaling: words with a blank between them, their counts and, of one side, their values."""

    def product(a, n, b, m, y):
        # The other side's value of a word is its count times the idf, which is y / m.
        other = dict(zip(b.split(" "), zip(y.tolist(), m.tolist())))
        return sum(count * other[word][0] / other[word][1] * other[word][0] for word, count in zip(a.split(" "), n.tolist()) if word in other)

    return pd.Series([product(*row) for row in zip(words_a, tf_a, words_b, tf_b, raw_b)], dtype=float)


def pair_similarity(df: DataFrame, pairs: DataFrame, keys: list[str], id_col: str, text_col: str) -> DataFrame:
    """Add `similarity`, the TF-IDF cosine of id_a and id_b, to pairs told apart by `keys`.

    Document frequencies come from the whole corpus, weights only from the documents in the pairs. A vector is one row: the counts of id_a's words go to
    id_b with the pair, where the two are multiplied.
    """
    idf = stage(inverse_frequency(df, text_col), "idf")
    pairs = stage(pairs, "tries")
    needed = stage(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "needed")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(needed, "id", "left_semi")
    # No term holds a blank.
    columns = [F.array_join(F.col("terms.term"), " ").alias("words"), F.col("terms.tf").alias("tf"), F.col("terms.raw").alias("raw")]
    found = stage(vectors(docs, idf).select("id", "length", *columns), "vectors")
    left = found.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "length", "words", "tf")])
    right = found.select(*[F.col(c).alias(f"{c}_b") for c in found.columns])
    # A row of a small class may be in a third of the pairs: a skewed key, split at run time.
    matched = left.join(pairs, "id_a").join(right, "id_b")
    product = F.pandas_udf(inner_products, "double")("words_a", "tf_a", "words_b", "tf_b", "raw_b")
    product = product / (F.col("length_a") * F.col("length_b"))
    scores = matched.select(*keys, product.alias("product")).groupBy(*keys).agg(F.sum("product").alias("similarity"))
    return pairs.join(scores, keys, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
