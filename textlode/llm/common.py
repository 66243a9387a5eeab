"""Small helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once per row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder all executors share and read it back: computed once, lineage cut.

    The folder is the session's spark.checkpoint.dir; where it is unset, as in tests, the session's warehouse.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder `fold`; a null id is not held out."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    return F.coalesce(rest == fold, F.lit(False))


def slots(rows: int, per_slot: int) -> int:
    """How many tasks of about `per_slot` rows the rows need."""
    return max(1, -(-rows // per_slot))
