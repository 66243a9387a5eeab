"""Renames, checks, filters and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators.scale import attach

# Column names of raw review files and their names here.
REVIEW_COLUMNS = {"reviewText": "text", "main_category": "label", "overall": "rating"}


def rename_columns(df: DataFrame, names: dict[str, str] = REVIEW_COLUMNS) -> DataFrame:
    """Rename the columns that are present, unless the new name is already taken."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns and new not in df.columns})


def require_columns(df: DataFrame, needed=("text", "label")) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {', '.join(missing)}")
    return df


def drop_nulls(df: DataFrame, subset=("text", "label")) -> DataFrame:
    return df.dropna(subset=list(subset))


def trim_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Trim the text and drop rows where it is null or blank."""
    return df.withColumn(text_col, T.strip(text_col)).where(F.col(text_col) != "")


def add_lengths(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add char_length (code points) and word_count (whitespace tokens)."""
    return df.withColumns({"char_length": F.length(text_col), "word_count": T.word_count(text_col)})


def keep_categories(df: DataFrame, categories: list[str], label_col: str = "label") -> DataFrame:
    return df.where(F.col(label_col).isin(list(categories)))


def drop_categories(df: DataFrame, categories: list[str], label_col: str = "label") -> DataFrame:
    """Rows of all other classes, those without a class too. Names that do not occur are ignored."""
    return df.where(~F.coalesce(F.col(label_col).isin(list(categories)), F.lit(False)))


def semi_on_classes(df: DataFrame, classes: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows whose class is in the table `classes`."""
    return attach(df, classes.select(label_col).distinct(), [label_col], "left_semi")


def anti_on_classes(df: DataFrame, classes: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows whose class is not in the table `classes`."""
    return attach(df, classes.select(label_col).distinct(), [label_col], "left_anti")


def strip_messages(df: DataFrame, text_col: str = "text", remove=("headers", "footers", "quotes")) -> DataFrame:
    """Strip the chosen parts of newsgroup messages: headers first, then footers, then quotes.

    One projection per part, so that a part which reads the text twice does not compute the parts before it twice.
    """
    for part, step in (("headers", T.strip_header), ("footers", T.strip_footer), ("quotes", T.strip_quotes)):
        if part in remove:
            df = df.withColumn(text_col, step(text_col))
    return df


def preview(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name. A column missing in one frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def label_union(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Sorted distinct labels of both one-column frames."""
    return truth.union(predicted).distinct().orderBy(truth.columns[0])


def with_row_id(df: DataFrame, out: str = "id", chunk: int = 100_000) -> DataFrame:
    """Give a key to rows that have none: a 128-bit digest of the content with the number of the copy.

    Equal rows meet by their digest and are counted before and after the one shuffle, so no task holds all copies of a row
    that occurs very often; rows of more than `chunk` copies are dealt out again in chunks. Equal rows are interchangeable, so the ids do
    not depend on the partitioning.
    """
    cols = df.columns
    digest = F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    counted = df.groupBy(digest.alias("_digest")).agg(F.first(F.struct(*cols)).alias("_row"), F.count(F.lit(1)).alias("_copies"))
    few = counted.where(F.col("_copies") <= chunk).withColumn("_from", F.lit(0).cast("bigint"))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(chunk).cast("bigint")))
    many = counted.where(F.col("_copies") > chunk).withColumn("_from", starts).repartition("_digest", "_from")
    numbers = F.sequence(F.col("_from"), F.least(F.col("_copies"), F.col("_from") + chunk) - 1)
    rows = few.unionByName(many).withColumn("_copy", F.explode(numbers))
    return rows.select(F.md5(F.concat_ws(":", "_digest", "_copy")).alias(out), "_row.*")
