"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.functions import text as T


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), one row per column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column", "nulls")


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def top_categories(df: DataFrame, category_col: str = "category", n: int = 10) -> DataFrame | None:
    """The n largest categories; None if the table has no such column."""
    if category_col not in df.columns:
        return None
    return class_distribution(df, category_col).orderBy(F.desc("n"), category_col).limit(n)


def rating_distribution(df: DataFrame, rating_col: str = "rating") -> DataFrame:
    return class_distribution(df, rating_col)


def average_lengths(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Mean characters and words. Null texts do not count; their number is given."""
    return df.agg(
        F.avg(F.length(text_col)).alias("avg_chars"),
        F.avg(T.word_count(text_col)).alias("avg_words"),
        F.count_if(F.col(text_col).isNull()).alias("null_texts"),
    )


def corpus_totals(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.length(text_col)).alias("total_chars"),
        F.sum(T.word_count(text_col)).cast("bigint").alias("total_words"),
    )


def vocabulary_size(df: DataFrame, text_col: str = "text", approximate: bool = False) -> DataFrame:
    """Number of distinct whitespace tokens."""
    tokens = T.explode_words(df, text_col)
    if approximate:
        return tokens.agg(F.approx_count_distinct("word").alias("vocabulary_size"))
    return tokens.distinct().agg(F.count(F.lit(1)).alias("vocabulary_size"))


def length_histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """(bin, low, high, n) of the non-empty bins of equal width; a constant column has one bin."""
    values = df.select(value.cast("double").alias("value"))
    edges = values.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("edges")).scalar()
    placed = values.withColumn("edges", edges)
    lo, hi = F.col("edges.lo"), F.col("edges.hi")
    steps = F.coalesce(F.floor((F.col("value") - lo) * bins / F.nullif(hi - lo, F.lit(0.0))), F.lit(0))
    number = F.least(steps + 1, F.lit(bins)).cast("int")
    # Values are counted, not rows: the bin of a null is no bin.
    binned = placed.groupBy(number.alias("bin"), "edges").agg(F.count("value").alias("n")).where("n > 0")
    step = (hi - lo) / bins
    return binned.select(
        "bin", (lo + (F.col("bin") - 1) * step).alias("low"), (lo + F.col("bin") * step).alias("high"), "n"
    )


def skewness(largest: Column, smallest: Column) -> Column:
    """A corpus is skewed if its largest class is more than twice the smallest."""
    return F.when(largest > 2 * smallest, "Highly Skewed").otherwise("Balanced")


def complexity(classes: Column) -> Column:
    """More than 20 classes are high, more than 10 medium complexity."""
    return F.when(classes > 20, "High").when(classes > 10, "Medium").otherwise("Low")


def class_balance(df: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: smallest and largest class and the skewness flag."""
    sizes = class_distribution(df, label_col).where(F.col(label_col).isNotNull())
    return sizes.agg(F.max("n").alias("largest"), F.min("n").alias("smallest")).withColumn(
        "skewness", skewness(F.col("largest"), F.col("smallest"))
    )


def class_complexity(df: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: number of classes and the complexity flag."""
    names = df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    return names.agg(F.count(F.lit(1)).alias("classes")).withColumn("complexity", complexity(F.col("classes")))


def corpus_summary(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """One row with the whole profile.

    Counts and lengths come from one aggregate per class; only the vocabulary needs its own pass.
    """
    per_class = df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(text_col).alias("texts"),
        F.sum(F.length(text_col)).alias("chars"),
        F.sum(T.word_count(text_col)).alias("words"),
    )
    known = F.col(label_col).isNotNull()
    whole = per_class.agg(
        F.sum("n").alias("documents"),
        F.try_divide(F.sum("chars"), F.sum("texts")).alias("avg_chars"),
        F.try_divide(F.sum("words"), F.sum("texts")).alias("avg_words"),
        F.count_if(known).alias("classes"),
        F.max(F.when(known, F.col("n"))).alias("largest"),
        F.min(F.when(known, F.col("n"))).alias("smallest"),
    )
    return whole.select(
        "documents",
        "avg_chars",
        "avg_words",
        "classes",
        skewness(F.col("largest"), F.col("smallest")).alias("skewness"),
        vocabulary_size(df, text_col).scalar().alias("vocabulary_size"),
        complexity(F.col("classes")).alias("complexity"),
    )


def word_frequency(df: DataFrame, n: int = 100, text_col: str = "text") -> DataFrame:
    """The n most frequent lower-case words that are not stop words."""
    tokens = T.explode_words(df, F.lower(text_col))
    kept = tokens.where(~F.col("word").isin(T.STOP_WORDS))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)


def heavy_words(df: DataFrame, n: int = 20, tracked: int = 10_000, text_col: str = "text") -> DataFrame:
    """(word, estimate, bound): the n words of the highest estimated counts, from a mergeable sketch of at most `tracked` words a task.

    No word is shuffled. An estimate is at least the true count if it is above `bound`, and at most `bound` more; bound is 3.5 / tracked of all words.
    Stop words are left out, as in `word_frequency`.
    """
    tokens = T.explode_words(df, F.lower(text_col))
    kept = tokens.where(~F.col("word").isin(T.STOP_WORDS))
    found = kept.agg(F.expr(f"approx_top_k(word, {n}, {tracked})").alias("top"), F.count(F.lit(1)).alias("total"))
    rows = found.select(F.explode("top").alias("t"), F.ceil(3.5 * F.col("total") / tracked).alias("bound"))
    return rows.select(F.col("t.item").alias("word"), F.col("t.count").alias("estimate"), "bound")
