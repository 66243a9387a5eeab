"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlode.functions.text import STOP_WORDS, word_count
from textlode.operators import profile
from textlode.operators.scale import stage
from textlode.plans.catalog import sql
from textlode.plans.catalog.registry import documents, query, rated_documents

RATED = "rated AS (SELECT d.doc_id AS id, text, lang AS label, quality AS rating FROM documents d LEFT JOIN labels USING (doc_id))"


@query(
    "a1_null_counts",
    f"""WITH {RATED}, c AS (SELECT count(*) FILTER (id IS NULL) AS id, count(*) FILTER (text IS NULL) AS text,
    count(*) FILTER (label IS NULL) AS label, count(*) FILTER (rating IS NULL) AS rating FROM rated)
    SELECT "column", nulls FROM (UNPIVOT c ON id, text, label, rating INTO NAME "column" VALUE nulls)""",
)
def a1(spark, folder):
    return profile.null_counts(rated_documents(spark, folder).select("id", "text", "label", "rating"))


@query("a2_class_distribution", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1")
def a2(spark, folder):
    return profile.class_distribution(documents(spark, folder))


@query(
    "a3_top_categories",
    "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10",
)
def a3(spark, folder):
    return profile.top_categories(documents(spark, folder), "source")


@query("a4_rating_distribution", f"WITH {RATED} SELECT rating, count(*) AS n FROM rated GROUP BY 1")
def a4(spark, folder):
    return profile.rating_distribution(rated_documents(spark, folder))


@query(
    "a5_average_lengths",
    f"""SELECT round(avg(length(text)), 6) AS avg_chars, round(avg(len({sql.words()})), 6) AS avg_words,
    count(*) FILTER (text IS NULL) AS null_texts FROM documents""",
)
def a5(spark, folder):
    means = profile.average_lengths(documents(spark, folder))
    return means.select(F.round("avg_chars", 6).alias("avg_chars"), F.round("avg_words", 6).alias("avg_words"), "null_texts")


@query(
    "a6_corpus_totals",
    f"""SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS total_chars,
    CAST(sum(len({sql.words()})) AS BIGINT) AS total_words FROM documents""",
)
def a6(spark, folder):
    return profile.corpus_totals(documents(spark, folder))


@query("a7_vocabulary_size", f"SELECT count(DISTINCT w) AS vocabulary_size FROM (SELECT unnest({sql.words()}) AS w FROM documents)")
def a7(spark, folder):
    return profile.vocabulary_size(documents(spark, folder))


@query(
    "a8_length_histogram",
    f"""WITH v AS (SELECT len({sql.words()})::DOUBLE AS x FROM documents), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
    b AS (SELECT least(coalesce(floor((x - lo) * 50 / nullif(hi - lo, 0)), 0) + 1, 50)::INT AS bin, lo, hi FROM v, e)
    SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 50), 6) AS low, round(lo + bin * ((hi - lo) / 50), 6) AS high,
    count(*) AS n FROM b GROUP BY bin, lo, hi""",
)
def a8(spark, folder):
    bins = profile.length_histogram(documents(spark, folder), word_count("text"))
    return bins.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query(
    "a9_class_balance",
    """SELECT max(n) AS largest, min(n) AS smallest,
    CASE WHEN max(n) > 2 * min(n) THEN 'Highly Skewed' ELSE 'Balanced' END AS skewness
    FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)""",
)
def a9(spark, folder):
    return profile.class_balance(documents(spark, folder))


@query(
    "a10_class_complexity",
    """SELECT count(DISTINCT source) AS classes, CASE WHEN count(DISTINCT source) > 20 THEN 'High'
    WHEN count(DISTINCT source) > 10 THEN 'Medium' ELSE 'Low' END AS complexity FROM documents""",
)
def a10(spark, folder):
    return profile.class_complexity(documents(spark, folder), "source")


@query(
    "a11_corpus_summary",
    f"""SELECT count(*) AS documents, round(avg(length(text)), 6) AS avg_chars, round(avg(len({sql.words()})), 6) AS avg_words,
    count(DISTINCT lang) AS classes,
    (SELECT CASE WHEN max(n) > 2 * min(n) THEN 'Highly Skewed' ELSE 'Balanced' END
      FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) AS skewness,
    (SELECT count(DISTINCT w) FROM (SELECT unnest({sql.words()}) AS w FROM documents)) AS vocabulary_size,
    CASE WHEN count(DISTINCT lang) > 20 THEN 'High' WHEN count(DISTINCT lang) > 10 THEN 'Medium' ELSE 'Low' END AS complexity
    FROM documents""",
)
def a11(spark, folder):
    one = profile.corpus_summary(documents(spark, folder))
    return one.withColumns({"avg_chars": F.round("avg_chars", 6), "avg_words": F.round("avg_words", 6)})


TOP_WORDS = 100
STOP_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


@query(
    "a12_word_frequency",
    f"""SELECT word, count(*) AS n FROM (SELECT unnest({sql.words('lower(text)')}) AS word FROM documents)
    WHERE word NOT IN ({STOP_LIST}) GROUP BY 1 ORDER BY n DESC, word LIMIT {TOP_WORDS}""",
)
def a12(spark, folder):
    return profile.word_frequency(documents(spark, folder), TOP_WORDS)


HEAVY = 20


@query("a12_heavy_words", f"SELECT {HEAVY} AS reported, true AS within_bound, true AS none_missed")
def a12_heavy(spark, folder):
    """The sketch against exact counts: every estimate within its bound, and no word missing that is above the last one by more than that."""
    docs = documents(spark, folder)
    found = stage(profile.heavy_words(docs, HEAVY), "heavy")
    exact = stage(profile.word_frequency(docs, 10 * HEAVY), "exact")
    both = exact.join(found, "word", "full").select("word", "n", "estimate", "bound")
    bound, last = (F.max(c).over(Window.partitionBy()) for c in ("bound", F.when(F.col("estimate").isNotNull(), -F.col("estimate"))))
    both = both.select("n", "estimate", bound.alias("bound"), (-last).alias("last"))
    gap = F.col("estimate") - F.col("n")
    return both.agg(
        F.count("estimate").cast("int").alias("reported"),
        F.bool_and(F.when(F.col("estimate").isNotNull(), F.coalesce(F.abs(gap) <= F.col("bound"), F.lit(False)))).alias("within_bound"),
        F.bool_and(F.when(F.col("estimate").isNull(), F.col("n") <= F.col("last") + F.col("bound"))).alias("none_missed"),
    )
