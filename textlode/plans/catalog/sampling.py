"""Samples, label numbers and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlode.operators import labels, splits
from textlode.plans.catalog import sql
from textlode.plans.catalog.registry import documents, query, rated_documents

SAMPLE = 300
NAMES = "names AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS label_id FROM docs GROUP BY 1)"


def _docs(spark, folder):
    return documents(spark, folder).select("id", "text", "label", "source")


@query(
    "l1_sample",
    f"WITH {sql.DOCS} SELECT id, text, label FROM docs ORDER BY {sql.key('sample')}, id LIMIT {SAMPLE}",
)
def l1(spark, folder):
    return splits.sample_rows(_docs(spark, folder), SAMPLE).select("id", "text", "label")


@query("l2_label_encode", f"WITH {sql.DOCS}, {NAMES} SELECT id, label, label_id FROM docs JOIN names USING (label)")
def l2(spark, folder):
    return labels.encode_labels(_docs(spark, folder)).select("id", "label", "label_id")


@query(
    "l3_label_decode",
    f"""WITH {sql.DOCS}, {NAMES} SELECT label_id, label, count(*) AS n FROM docs JOIN names USING (label)
    WHERE length(text) > 1000 GROUP BY ALL""",
)
def l3(spark, folder):
    docs = _docs(spark, folder)
    names = labels.label_dictionary(docs)
    long = labels.encode_labels(docs).where(F.length("text") > 1000).drop("label")
    used = labels.labels_in_use(long, names)
    counts = long.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    return labels.decode_labels(counts, used).select("label_id", "label", "n")


@query(
    "l4_random_split",
    f"""WITH {sql.DOCS}, r AS (SELECT *, row_number() OVER (ORDER BY {sql.key('split')}, id) AS place, count(*) OVER () AS n FROM docs)
    SELECT id, label, CASE WHEN place <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def l4(spark, folder):
    return splits.random_split(_docs(spark, folder)).select("id", "label", "split")


@query(
    "l5_stratified_split",
    f"""WITH {sql.DOCS}, {sql.three_way('docs', 'source')}
    SELECT id, source, CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS split FROM split""",
)
def l5(spark, folder):
    return splits.stratified_split(_docs(spark, folder), label_col="source").select("id", "source", "split")


@query(
    "l5_stratified_split_nullable",
    f"""WITH {sql.RATED}, {sql.three_way('rated', 'rating')}
    SELECT id, rating, CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS split FROM split""",
)
def l5_nullable(spark, folder):
    rated = rated_documents(spark, folder).select("id", "rating")
    return splits.stratified_split(rated, label_col="rating").select("id", "rating", "split")


@query("l6_three_way_split", f"WITH {sql.DOCS}, {sql.three_way('docs', 'label')} SELECT id, label, split FROM split")
def l6(spark, folder):
    return splits.three_way_split(_docs(spark, folder)).select("id", "label", "split")


HELD = f"""{sql.DOCS}, known AS (SELECT * FROM docs WHERE label NOT IN ('es', 'fr')),
heldrows AS (SELECT * FROM docs WHERE label IN ('es', 'fr')), {sql.three_way('known', 'label')}, {sql.holdout('heldrows', 'label')},
everything AS (SELECT * FROM split UNION ALL BY NAME SELECT * FROM held)"""
CLASSES = ["es", "fr", "no such class"]


@query("l7_holdout_few_shot", f"WITH {HELD} SELECT id, label, split FROM everything")
def l7(spark, folder):
    return splits.split_corpus(_docs(spark, folder), CLASSES).select("id", "label", "split")


@query(
    "l8_split_accessors",
    f"WITH {HELD} SELECT split, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM everything "
    "WHERE split IN ('val', 'holdout_example', 'holdout_test') GROUP BY 1",
)
def l8(spark, folder):
    parts = splits.split_corpus(_docs(spark, folder), CLASSES)
    chosen = splits.rows_of(parts, "val", "holdout_example", "holdout_test")
    return chosen.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
