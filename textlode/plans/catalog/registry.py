"""Registration of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.operators.splits import split_corpus, three_way_split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text, label, source) with the language as label."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), "source"
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """(id, embedding, label_id)."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("label_id")
    )


def changed(vec_col: str = "embedding"):
    """A second version of a vector: every third element as it is, the others stretched."""
    return F.transform(vec_col, lambda x, i: x.cast("double") * (1.0 + 0.1 * (i % 3)))


def rated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text, label, rating): documents with their quality as rating, null where there is none."""
    rating = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("rating"))
    return documents(spark, folder).join(rating, "id", "left")


def split_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings with column `split`."""
    return three_way_split(embeddings(spark, folder), label_col="label_id")


def few_shot_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The same with classes 8 and 9 held out."""
    return split_corpus(embeddings(spark, folder), [8, 9], label_col="label_id")
