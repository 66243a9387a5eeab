"""Training pairs drawn from the documents, language as label."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlode.operators import pairs as P
from textlode.plans.catalog import sql
from textlode.plans.catalog.registry import documents, query

DRAWS = 10_000
BASE = f"{sql.DOCS}, {sql.classes('docs')}"


def _texts(pairs, *keep):
    """Digests of the texts in place of the texts, which repeat in many pairs."""
    return pairs.select(*keep, "id_a", "id_b", F.md5("text_a").alias("text_a"), F.md5("text_b").alias("text_b"))


def _with_texts(source, columns):
    return f"""SELECT {columns}, id_a, id_b, md5(a.text) AS text_a, md5(b.text) AS text_b FROM {source}
    JOIN docs a ON a.id = id_a JOIN docs b ON b.id = id_b"""


@query(
    "t1_positive_pairs",
    f"WITH {BASE}, {sql.drawn(DRAWS)}, {sql.positives()} {_with_texts('positives', 'draw_id AS pair_id, positives.label')}",
)
def t1(spark, folder):
    return _texts(P.positive_pairs(documents(spark, folder), DRAWS), "pair_id", "label")


@query(
    "t2_labelled_pairs",
    f"WITH {BASE}, {sql.labelled_pairs(DRAWS // 2)} {_with_texts('pairs', 'pair_id, pairs.label')}",
)
def t2(spark, folder):
    return _texts(P.labelled_pairs(documents(spark, folder), DRAWS // 2), "pair_id", "label")


@query(
    "t3_mixed_pairs",
    f"""WITH {BASE}, {sql.labelled_pairs(DRAWS // 2)},
    mixed AS (SELECT * FROM pairs ORDER BY {sql.draw('shuffle', 'pair_id')}, pair_id LIMIT {DRAWS})
    {_with_texts('mixed', 'pair_id, mixed.label')}""",
)
def t3(spark, folder):
    return _texts(P.mixed_pairs(documents(spark, folder), DRAWS), "pair_id", "label")


@query(
    "t4_hard_negatives",
    f"""WITH {BASE}, {sql.drawn(DRAWS // 2)}, {sql.positives()}, {sql.tfidf()}, {sql.hardest('positives')},
    hard AS (SELECT draw_id * 2 AS pair_id, id_a, id_b, 1 AS label FROM positives
      UNION ALL SELECT draw_id * 2 + 1, id_a, id_b, 0 FROM hardest) {_with_texts('hard', 'pair_id, hard.label')}""",
)
def t4(spark, folder):
    return _texts(P.hard_negative_pairs(documents(spark, folder), DRAWS), "pair_id", "label")


def _number_pairs(quotas, take, size, salt):
    """CTE numbers: different numbers below `size` per class, drawn from equal stretches."""
    name = "concat_ws('-', CAST(label AS VARCHAR), CAST(nth AS VARCHAR))"
    return f"""
n0 AS (SELECT *, unnest(range({take})) AS nth FROM {quotas}),
n1 AS (SELECT *, {name} AS name, (nth::HUGEINT * {size}) // {take} AS low, ((nth + 1)::HUGEINT * {size}) // {take} AS high FROM n0),
numbers AS MATERIALIZED (SELECT *, low + {sql.draw(salt, 'name')} % (high - low) AS number FROM n1)"""


PLACES = """
f0 AS (SELECT *, number % n AS i, (number % n + number // n + 1) % n AS j FROM {0}),
places AS MATERIALIZED (SELECT f0.*, a.id AS id_a, b.id AS id_b FROM f0
  JOIN members a ON a.label = f0.label AND a.pos = least(i, j) JOIN members b ON b.label = f0.label AND b.pos = greatest(i, j))"""


@query(
    "t5_positive_combinations",
    f"""WITH {BASE}, quotas AS (SELECT *, n * (n - 1) // 2 AS pairs,
      least(n * (n - 1) // 2, {DRAWS} // (SELECT count(*) FROM class_table)) AS take FROM class_table),
    {_number_pairs('quotas', 'take', 'pairs', 'combination')}, {PLACES.format('numbers')}
    {_with_texts('places', 'name AS pair_id, places.label')}""",
)
def t5(spark, folder):
    return _texts(P.positive_combinations(documents(spark, folder), DRAWS), "pair_id", "label")


@query(
    "t6_validation_pairs",
    f"""WITH {BASE}, items0 AS (SELECT *, label AS grp, n * (n - 1) AS items FROM class_table),
    {sql.share('quotas', 'items0', 'items', 'least(total_, 1000)', 'take')},
    {_number_pairs('quotas', 'take', 'items', 'validation')},
    halves AS (SELECT * EXCLUDE (number), number % 2 = 0 AS positive, number // 2 AS number FROM numbers), {PLACES.format('halves')},
    anchors AS (SELECT name AS draw_id, id_a, n, start, everything FROM places WHERE NOT positive),
    {sql.tfidf()}, {sql.hardest('anchors')},
    valid AS (SELECT name AS pair_id, id_a, id_b, 1 AS label FROM places WHERE positive
      UNION ALL SELECT draw_id, id_a, id_b, 0 FROM hardest) {_with_texts('valid', 'pair_id, valid.label')}""",
)
def t6(spark, folder):
    return _texts(P.validation_pairs(documents(spark, folder)), "pair_id", "label")
