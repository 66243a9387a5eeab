"""Exact random cuts and exact random positions without sorting whole groups.

A group may hold a third of all rows, so `row_number() over (partition by group)` would put it into one task.
Instead the rows are counted per (group, bucket), where the bucket is the front of the random key.
The running sum over that table tells which bucket holds the n-th row, and only that bucket
is ranked. The wide rows are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlode.functions.keys import BUCKET_DIGITS, SEED, bucket_of, hash_key
from textlode.operators.scale import attach, join_null_safe, stage

BUCKETS = 16**BUCKET_DIGITS


def keyed(df: DataFrame, id_col: str, group: str | None, salt: str, seed: int = SEED) -> DataFrame:
    """The narrow table (grp, key, bucket, id) all cuts work on. `id_col` must be unique."""
    grp = F.col(group) if group else F.lit(0)
    key = hash_key(id_col, salt, seed)
    return df.select(grp.alias("grp"), key.alias("key"), F.col(id_col).alias("id")).withColumn(
        "bucket", bucket_of("key")
    )


def bucket_offsets(rows: DataFrame) -> DataFrame:
    """(grp, bucket, n, start, total): `start` rows of the group lie in lower buckets."""
    counts = rows.groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("n"))
    running = W.partitionBy("grp").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("grp")
    return counts.select(
        "grp",
        "bucket",
        "n",
        (F.sum("n").over(running) - F.col("n")).alias("start"),
        F.sum("n").over(whole).alias("total"),
    )


def cut_points(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """(grp, part, cut): the struct (key, id) of the `upto`-th row of each group, a null group included.

    `quotas` has (grp, part, upto). An `upto` beyond the group's size cuts after its last row, one
    below 1 gives no row.
    """
    edges = (
        join_null_safe(bucket_offsets(rows), quotas, ["grp"])
        .withColumn("upto", F.least("upto", "total"))
        .where((F.col("start") < F.col("upto")) & (F.col("upto") <= F.col("start") + F.col("n")))
        .select("grp", "part", "bucket", (F.col("upto") - F.col("start")).alias("need"))
    )
    at_edge = attach(rows, edges, ["grp", "bucket"])
    by_key = W.partitionBy("grp", "part", "bucket").orderBy("key", "id")
    return (
        at_edge.withColumn("nth", F.row_number().over(by_key))
        .where(F.col("nth") == F.col("need"))
        .select("grp", "part", F.struct("key", "id").alias("cut"))
    )


def mark_parts(
    df: DataFrame,
    id_col: str,
    group: str | None,
    quotas: DataFrame,
    parts: list[str],
    rest: str,
    out: str,
    salt: str,
    seed: int = SEED,
) -> DataFrame:
    """Add column `out`: the first of `parts` whose cut covers the row, else `rest`.

    The parts take consecutive stretches of each group's random order, so the `upto` of a part
    includes the parts before it.

    The few cut points are staged. Marking is then a comparison during the scan, so the parts can be
    read any number of times without finding the cuts again and without a copy of the table.
    """
    rows = keyed(df, id_col, group, salt, seed)
    points = cut_points(rows, quotas)
    wide = points.groupBy("grp").agg(
        *[F.max(F.when(F.col("part") == p, F.col("cut"))).alias(f"_cut{i}") for i, p in enumerate(parts)]
    )
    grp = F.col(group) if group else F.lit(0)
    marked = attach(df.withColumn("_grp", grp), wide.withColumnRenamed("grp", "_grp"), ["_grp"], "left")
    here = F.struct(hash_key(id_col, salt, seed).alias("key"), F.col(id_col).alias("id"))
    choice: Column = F.lit(rest)
    for i, part in reversed(list(enumerate(parts))):
        choice = F.when(here <= F.col(f"_cut{i}"), F.lit(part)).otherwise(choice)
    return marked.withColumn(out, choice).drop("_grp", *[f"_cut{i}" for i in range(len(parts))])


def take_per_group(
    df: DataFrame, id_col: str, group: str | None, n: int, salt: str, seed: int = SEED
) -> DataFrame:
    """Exactly min(n, size) random rows of each group, or of the whole table without `group`."""
    spark = df.sparkSession
    if group:
        quotas = df.select(F.col(group).alias("grp")).distinct()
        quotas = quotas.select("grp", F.lit("taken").alias("part"), F.lit(n).cast("bigint").alias("upto"))
    else:
        quotas = spark.range(1).select(
            F.lit(0).alias("grp"), F.lit("taken").alias("part"), F.lit(n).cast("bigint").alias("upto")
        )
    marked = mark_parts(df, id_col, group, quotas, ["taken"], "left", "_part", salt, seed)
    return marked.where(F.col("_part") == "taken").drop("_part")


def range_lookup(points: DataFrame, ranges: DataFrame, on: list[str], pos: str, total: str) -> DataFrame:
    """Join each point to the range [start, start + n) its column `pos` lies in.

    Done as an equi-join on slots of equal width, at most BUCKETS of them per key, so that neither
    a wide range nor a crowded one ends up in one task. Both sides hold `total`, the sum of all n of the key.
    """

    def slot(position):
        width = F.greatest(F.lit(1), F.ceil(F.col(total) / BUCKETS))
        return F.floor(position / width)

    first, last = slot(F.col("start")), slot(F.col("start") + F.col("n") - 1)
    slots = ranges.withColumn("_slot", F.explode(F.sequence(first, last))).drop(total)
    slots = slots.withColumnsRenamed({"start": "_start", "n": "_n"})
    return (
        points.withColumn("_slot", slot(F.col(pos)))
        .join(slots, [*on, "_slot"])
        .where((F.col("_start") <= F.col(pos)) & (F.col(pos) < F.col("_start") + F.col("_n")))
        .withColumn("_within", F.col(pos) - F.col("_start"))
        .drop("_slot", "_start", "_n")
    )


def rows_at(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add `id` to `wanted`: the row at position `pos` (from 0) of the random order of group `grp`.

    `rows` comes from `keyed`; `wanted` also holds `total`, the size of the group. Each position is
    first located in its bucket, then only the buckets hit are ranked. A position drawn very
    often (a class of two rows, say) is a skewed key of a plain join, which is split at run time.
    """
    # Read twice below: for the positions and for the buckets to rank.
    placed = stage(range_lookup(wanted, bucket_offsets(rows), ["grp"], "pos", "total"), "positions")
    hit = placed.select("grp", "bucket").distinct()
    by_key = W.partitionBy("grp", "bucket").orderBy("key", "id")
    ranked = (
        rows.join(hit, ["grp", "bucket"], "left_semi")
        .withColumn("_within", F.row_number().over(by_key) - 1)
        .select("grp", "bucket", "_within", "id")
    )
    return placed.join(ranked, ["grp", "bucket", "_within"]).drop("bucket", "_within", "total")


def dense_positions(rows: DataFrame) -> DataFrame:
    """(grp, id, pos): the position of every row in the random order of its group, from 0."""
    offsets = bucket_offsets(rows).select("grp", "bucket", "start")
    by_key = W.partitionBy("grp", "bucket").orderBy("key", "id")
    ranked = rows.withColumn("nth", F.row_number().over(by_key) - 1)
    return ranked.join(offsets, ["grp", "bucket"]).select("grp", "id", (F.col("start") + F.col("nth")).alias("pos"))
