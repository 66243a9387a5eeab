"""Label dictionary: class names and their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.operators.scale import attach, numbered


def label_dictionary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, label_id): id is the rank of the name in sorted order, from 0. One row per class."""
    names = df.select(F.col(label_col).alias("label")).where(F.col(label_col).isNotNull()).distinct()
    return numbered(names, ["label"], "label_id").select("label", F.col("label_id").cast("int").alias("label_id"))


def encode_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Add label_id to each row; a null label has a null number."""
    names = label_dictionary(df, label_col).withColumnRenamed("label", label_col)
    return attach(df, names, [label_col], "left")


def decode_labels(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add the class name `label` to rows that have a label_id."""
    return attach(df, dictionary, ["label_id"], "left")


def labels_in_use(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The part of the dictionary whose ids occur in `df`."""
    return dictionary.join(df.select("label_id").distinct(), "label_id", "left_semi")
