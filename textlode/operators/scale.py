"""Helpers that keep joins and numbering safe at scale: staged tables, null-safe joins, distributed numbers.

No plan here depends on a count. Joins carry no broadcast hint (but for the frequent terms of tfidf.py, a bounded table): Spark broadcasts a side whose bytes are known to be below
spark.sql.autoBroadcastJoinThreshold, and splits skewed keys of the others at run time. Staged tables have exact file
sizes, so that choice is made before the wide side would be shuffled.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can see: the session's checkpoint folder, and where none is set its warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textlode/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where a result is read several times: it is computed once, its lineage is cut, and it
    outlives lost executors.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the keys are those of `left`."""
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(other, same, how).drop(*[f"_right_{c}" for c in on])


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a class-level table to a big one; null keys match null keys."""
    return join_null_safe(big, stage(small, "class-table"), on, how)


def with_sides(pairs: DataFrame, table: DataFrame, keys: list[str], id_col: str, value_col: str, name: str) -> DataFrame:
    """Add name_a and name_b, the values of a table's rows id_a and id_b, to pairs told apart by `keys`.

    The pairs' own columns travel with their ends, so the values are grouped once and not joined back.
    """
    ends = F.array(*[F.struct(F.lit(s).alias("_side"), F.col(f"id_{s}").alias("_id")) for s in "ab"])
    values = table.select(F.col(id_col).alias("_id"), F.col(value_col).alias("_value"))
    sides = stage(pairs.select("*", F.explode(ends).alias("_end")).select(*pairs.columns, "_end.*"), "sides")
    wide = values.join(sides, "_id").groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in pairs.columns if c not in keys],
        *[F.first(F.when(F.col("_side") == s, F.col("_value")), ignorenulls=True).alias(f"{name}_{s}") for s in "ab"],
    )
    return wide.select(*pairs.columns, f"{name}_a", f"{name}_b")


def running_sums(df: DataFrame, by: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """Add, for each output -> column of `sums`, the sum of the rows before this one in the order, within each group `by`.

    Without a window over a whole group: the rows are cut into ranges of the order, ranges are added up, and only
    the table of ranges, as long as the number of partitions times groups, is summed in a row. `order` must be total within a group.
    """
    placed = stage(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    up_to = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", *[F.sum(f"_t_{out}").over(up_to).alias(f"_s_{out}") for out in sums])
    within = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    rows = placed.withColumns({f"_w_{out}": F.sum(c).over(within) for out, c in sums.items()})
    rows = join_null_safe(rows, starts, [*by, "_range"])
    return rows.withColumns(
        {out: F.coalesce(f"_w_{out}", zero) + F.coalesce(f"_s_{out}", zero) for out in sums}
    ).drop("_range", *[f"_{x}_{out}" for out in sums for x in "sw"])


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Add the place of each row in the order, from 0, without sorting the table in one task."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), [], order, {out: "_one"}).drop("_one")
