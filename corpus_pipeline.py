"""The training-data pipeline: quality rules, toxicity, near copies, mixing, packing.

Each stage takes the documents its predecessor kept, all of them, and returns those it keeps with the columns of
documents; the last one returns packed pieces. Stages are written as Parquet in the folder all executors share and read again,
so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlode.llm import mixing, nearjoin, packing, quality, toxicity
from textlode.llm.common import held_out, staged, table
from textlode.llm.queries import MIX, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and that the label model holds to be good."""
    return quality.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half by a classifier learnt from the labelled ones among them that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return toxicity.without_toxic(docs, toxicity.train(*toxicity.sample(docs, labels)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id."""
    return nearjoin.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order."""
    return mixing.mix(docs, MIX).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2,048 tokens."""
    return packing.pack(packing.pieces_of(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", good_quality),
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Trained models, tokens and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
