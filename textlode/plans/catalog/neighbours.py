"""Exact nearest neighbours and evaluation runs on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlode.operators.knn import grow_index, knn, knn_probe, majority_vote, ranked_labels, recall, train_cells
from textlode.operators.scale import stage
from textlode.operators.splits import rows_of
from textlode.plans import evaluation
from textlode.plans.catalog import sql
from textlode.plans.catalog.registry import changed, few_shot_embeddings, query, split_embeddings


def _near(spark, folder):
    split = split_embeddings(spark, folder)
    return knn(rows_of(split, "test"), rows_of(split, "train"))


NEAR = "SELECT query_id, CAST(rank AS INT) AS rank, neighbour_id, round(d ^ 2, 6) AS dist FROM near"


@query("j1_knn", f"WITH {sql.KNN_SPLIT} {NEAR}")
def j1(spark, folder):
    return _near(spark, folder).select("query_id", "rank", "neighbour_id", F.round("dist", 6).alias("dist"))


CELLS, PROBES, ENOUGH = 16, 12, 0.9


@query(
    "j1_probed_recall",
    f"""WITH {sql.VECS}, {sql.three_way('vecs', 'label_id')}
    SELECT count(*) AS queries, sum(least(5, (SELECT count(*) FROM split WHERE split = 'train')))::BIGINT AS neighbours, true AS enough
    FROM split WHERE split = 'test'""",
)
def j1_probed(spark, folder):
    """Approximate neighbours against the exact ones: k-means cells over the index, each query meets the nearest of them."""
    split = stage(split_embeddings(spark, folder), "split")
    queries, index = rows_of(split, "test"), rows_of(split, "train")
    found = knn_probe(queries, index, train_cells(index, CELLS), PROBES)
    return recall(found, knn(queries, index)).select("queries", "neighbours", (F.col("recall") >= ENOUGH).alias("enough"))


@query("j2_neighbour_labels", f"WITH {sql.KNN_SPLIT} SELECT query_id, CAST(rank AS INT) AS rank, label_id FROM near")
def j2(spark, folder):
    return _near(spark, folder).select("query_id", "rank", "label_id")


GROWN = f"""WITH {sql.FEW_SHOT},
queries AS (SELECT * FROM everything WHERE split IN ('test', 'holdout_test')),
points AS (SELECT * FROM everything WHERE split IN ('train', 'holdout_example')), {sql.knn('queries', 'points')}"""


@query("j5_index_growth", f"{GROWN} {NEAR}")
def j5(spark, folder):
    split = few_shot_embeddings(spark, folder)
    index = grow_index(rows_of(split, "train"), rows_of(split, "holdout_example"))
    near = knn(rows_of(split, "test", "holdout_test"), index)
    return near.select("query_id", "rank", "neighbour_id", F.round("dist", 6).alias("dist"))


@query("k1_knn_vote", f"WITH {sql.SCORED} SELECT query_id, pred FROM scored")
def k1(spark, folder):
    return majority_vote(_near(spark, folder))


@query("k2_ranked_labels", f"WITH {sql.SCORED} SELECT query_id, array_to_string(labels, ' ') AS labels FROM scored")
def k2(spark, folder):
    return ranked_labels(_near(spark, folder)).withColumn("labels", F.array_join("labels", " "))


def rounded(df):
    names = ("accuracy", "precision", "recall", "f1", "mrr", "topk_accuracy", "log_loss", "perplexity")
    names += ("macro_precision", "macro_recall", "macro_f1")
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c in names})


@query("k3_evaluation", f"WITH {sql.SCORED}, {sql.class_scores()} {sql.EVALUATION}")
def k3(spark, folder):
    return rounded(evaluation.evaluate_split(split_embeddings(spark, folder)))


@query(
    "k3_evaluation_report",
    f"""WITH {sql.SCORED}, {sql.class_scores()}
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM classes""",
)
def k3_report(spark, folder):
    return rounded(evaluation.evaluate_with_report(split_embeddings(spark, folder))[1])


@query("k4_few_shot_evaluation", f"{GROWN}, {sql.votes()}, {sql.class_scores()} {sql.EVALUATION}")
def k4(spark, folder):
    return rounded(evaluation.evaluate_few_shot(few_shot_embeddings(spark, folder)))


COMPARE = f"""WITH {sql.VECS}, {sql.three_way('vecs', 'label_id')},
versions AS (SELECT *, list_transform(v, lambda x, i: x * (1.0::DOUBLE + 0.1::DOUBLE * ((i - 1) % 3))) AS w FROM split),
queries AS (SELECT * FROM versions WHERE split = 'test'), points AS (SELECT * FROM versions WHERE split = 'train'),
{sql.knn('queries', 'points')}, {sql.votes()}, {sql.class_scores()}, base AS ({sql.EVALUATION}),
{sql.knn('queries', 'points', out='near2', v='w')}, {sql.votes('near2', out='scored2').replace('per_label', 'per_label2')},
{sql.class_scores('scored2', 'classes2')}, other AS ({sql.EVALUATION.replace('FROM classes', 'FROM classes2').replace('FROM scored', 'FROM scored2')})
SELECT 'base' AS model, * FROM base UNION ALL SELECT 'changed', * FROM other"""


@query("k5_compare_embeddings", COMPARE)
def k5(spark, folder):
    split = split_embeddings(spark, folder).withColumn("after", changed())
    return rounded(evaluation.compare_embeddings(split, {"base": "embedding", "changed": "after"}))
