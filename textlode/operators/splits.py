"""Samples, splits and hold-out classes. All sizes are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.functions.keys import SEED
from textlode.operators.clean import drop_categories, keep_categories
from textlode.operators.cuts import mark_parts, take_per_group
from textlode.operators.scale import numbered, stage

WIDE = "decimal(38,0)"


def sample_rows(df: DataFrame, n: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """min(n, rows) random rows without replacement."""
    return take_per_group(df, id_col, None, n, "sample", seed)


def cap_per_source(df: DataFrame, n: int, source_col: str, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """At most n rows of each source."""
    return take_per_group(df, id_col, source_col, n, "cap", seed)


def random_split(
    df: DataFrame, test_size: float = 0.2, id_col: str = "id", seed: int = SEED, out: str = "split"
) -> DataFrame:
    """Add column `split`: exactly ceil(test_size * rows) rows are `test`, the others `train`."""
    quotas = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("grp"), F.lit("test").alias("part"), F.ceil(F.lit(test_size) * F.col("n")).alias("upto")
    )
    return mark_parts(df, id_col, None, quotas, ["test"], "train", out, "split", seed)


def share_out(counts: DataFrame, wanted: Column, n_col: str, out: str) -> DataFrame:
    """Share `wanted` rows out among the classes in proportion to `n_col`, by largest remainder.

    `counts` has one row per class with its name in `grp`; `wanted` may use `_total`, the sum of
    `n_col`. Ties of the remainder go to the first class name, null last.
    """
    counts = stage(counts, "shares")
    total = counts.agg(F.sum(n_col).cast(WIDE).alias("t")).first()["t"]
    table = counts.withColumn("_total", F.lit(total).cast(WIDE))
    table = table.withColumn("_share", wanted.cast("decimal(13,0)") * F.col(n_col).cast("decimal(24,0)"))
    table = table.withColumns(
        {"_floor": F.expr("cast(_share div _total as bigint)"), "_left": F.expr("_share % _total")}
    )
    table = numbered(table, [F.desc("_left"), F.asc_nulls_last("grp")], "_rank")
    spare = table.agg(F.max(wanted.cast("bigint")) - F.sum("_floor")).first()[0] or 0
    table = table.withColumn(out, F.col("_floor") + F.when(F.col("_rank") < spare, 1).otherwise(0))
    return table.drop("_total", "_share", "_floor", "_left", "_rank")


def class_quotas(df: DataFrame, label_col: str, sizes: dict[str, float]) -> DataFrame:
    """(grp, part, upto) for `mark_parts`. Rows without a label are a class of their own.

    Each part takes its share of the rows that the parts before it left over.
    """
    counts = df.groupBy(F.col(label_col).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    table = counts.withColumns({"rest": F.col("n"), "upto": F.lit(0).cast("bigint")})
    columns = []
    for part, size in sizes.items():
        wanted = F.ceil(F.lit(size) * F.col("_total").cast("double"))
        table = share_out(table, wanted, "rest", "_take")
        table = table.withColumns({"upto": F.col("upto") + F.col("_take"), "rest": F.col("rest") - F.col("_take")})
        table = table.withColumnRenamed("_take", f"take_{part}").withColumn(f"upto_{part}", F.col("upto"))
        columns.append(F.struct(F.lit(part).alias("part"), F.col(f"upto_{part}").alias("upto")))
    table = stage(table, "class-counts")
    facts = table.agg(
        F.count(F.lit(1)).alias("classes"),
        F.min("n").alias("smallest"),
        *[F.sum(f"take_{part}").alias(part) for part in sizes],
    ).first()
    if facts["classes"] and facts["smallest"] < 2:
        raise ValueError("the smallest class has fewer than 2 rows; a stratified split needs 2")
    for part in sizes:
        if facts["classes"] and facts[part] < facts["classes"]:
            raise ValueError(f"part {part} has {facts[part]} rows for {facts['classes']} classes")
    return table.select("grp", F.explode(F.array(*columns)).alias("q")).select("grp", "q.part", "q.upto")


def stratified_split(
    df: DataFrame,
    test_size: float = 0.2,
    id_col: str = "id",
    label_col: str = "label",
    seed: int = SEED,
    out: str = "split",
) -> DataFrame:
    """Like `random_split`, with the class shares of the whole table in both parts."""
    quotas = class_quotas(df, label_col, {"test": test_size})
    return mark_parts(df, id_col, label_col, quotas, ["test"], "train", out, "strat", seed)


def three_way_split(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.1,
    id_col: str = "id",
    label_col: str = "label",
    seed: int = SEED,
    out: str = "split",
) -> DataFrame:
    """Stratified `test`, then `val` from the rest, then `train`."""
    quotas = class_quotas(df, label_col, {"test": test_size, "val": val_size})
    return mark_parts(df, id_col, label_col, quotas, ["test", "val"], "train", out, "strat", seed)


def holdout_split(
    df: DataFrame,
    holdout_classes: list,
    examples_per_class: int = 5,
    id_col: str = "id",
    label_col: str = "label",
    seed: int = SEED,
    out: str = "split",
) -> DataFrame:
    """Rows of the hold-out classes: `holdout_example` for a few of each class, else `holdout_test`."""
    held = keep_categories(df, holdout_classes, label_col)
    names = sorted(set(holdout_classes))
    quotas = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in names])).alias("grp")) if names else (
        held.select(F.col(label_col).alias("grp"))
    )
    quotas = quotas.select(
        F.col("grp").cast(df.schema[label_col].dataType),
        F.lit("holdout_example").alias("part"),
        F.lit(examples_per_class).cast("bigint").alias("upto"),
    )
    return mark_parts(held, id_col, label_col, quotas, ["holdout_example"], "holdout_test", out, "holdout", seed)


def split_corpus(
    df: DataFrame,
    holdout_classes: list | None = None,
    examples_per_class: int = 5,
    test_size: float = 0.2,
    val_size: float = 0.1,
    id_col: str = "id",
    label_col: str = "label",
    seed: int = SEED,
) -> DataFrame:
    """The whole split: train, val, test, and two hold-out parts for the hold-out classes."""
    held = list(holdout_classes or [])
    known = three_way_split(
        drop_categories(df, held, label_col) if held else df, test_size, val_size, id_col, label_col, seed
    )
    if not held:
        return known
    return known.unionByName(holdout_split(df, held, examples_per_class, id_col, label_col, seed))


def rows_of(df: DataFrame, *parts: str) -> DataFrame:
    """Rows of the named parts of a split table."""
    return df.where(F.col("split").isin(list(parts)))
