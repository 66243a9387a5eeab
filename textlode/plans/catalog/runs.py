"""Whole runs over the documents, language as label."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlode.operators.scale import new_path
from textlode.plans.catalog import sql
from textlode.plans.catalog.registry import documents, query
from textlode.plans.reviews import run_reviews

PER_SOURCE, SAMPLE = 100_000, 20_000


@query(
    "x1_review_run",
    f"""WITH {sql.DOCS}, capped AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sql.key('cap')}, id) <= {PER_SOURCE}),
    chosen AS (SELECT * FROM capped ORDER BY {sql.key('sample')}, id LIMIT {SAMPLE}),
    placed AS (SELECT *, row_number() OVER (ORDER BY {sql.key('split')}, id) AS place, count(*) OVER () AS n FROM chosen)
    SELECT label, CASE WHEN place <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split, count(*) AS n, true AS scored
    FROM placed GROUP BY 1, 2""",
)
def x1(spark, folder):
    """The run's split by class; `scored` says that the stored model has scores between 0 and 1 on it."""
    run = run_reviews(documents(spark, folder), new_path(spark, "reviews"), PER_SOURCE, SAMPLE)
    row = run.scores.first()
    scored = all(0 <= row[c] <= 1 for c in ("accuracy", "precision", "recall", "f1"))
    return run.split.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")).withColumn("scored", F.lit(scored))
