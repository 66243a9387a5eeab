"""Nearest-neighbour evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.operators import metrics as M
from textlode.operators.clean import union_all
from textlode.operators.knn import grow_index, knn, votes
from textlode.operators.scale import stage
from textlode.operators.splits import rows_of


def score_queries(
    queries: DataFrame,
    index: DataFrame,
    k_vote: int = 5,
    k_labels: int = 5,
    id_col: str = "id",
    vec_col: str = "embedding",
    label_col: str = "label_id",
) -> DataFrame:
    """(query_id, label_id, pred, labels, share): the truth and what the neighbours say, one search for all.

    Every query gives a row: one without a usable vector, or with an empty index, has null in pred, labels and share.
    """
    neighbours = knn(queries, index, max(k_vote, k_labels), id_col, vec_col, label_col)
    truth = queries.select(F.col(id_col).alias("query_id"), F.col(label_col).alias("label_id"))
    return truth.join(votes(neighbours, k_vote, k_labels), "query_id", "left")


def evaluate(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row of all metrics from scored queries.

    The confusion aggregate carries the sums of the per-query metrics, so the search is run once. Queries without neighbours
    are in all denominators: they are wrong, rank nothing and give the true class no probability. `unscored` counts them.
    """
    zero = F.lit(0.0)
    cells = scored.groupBy(*by, F.col("label_id").alias("label"), "pred").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(M.hit(), zero)).alias("hits_k"),
        F.sum(F.coalesce(M.reciprocal_rank(), zero)).alias("rr"),
        F.sum(M.clipped_loss(F.coalesce(M.share_of(), zero))).alias("loss"),
        F.sum(F.col("pred").isNull().cast("double")).alias("missed"),
    )
    total = F.sum("support")
    return (
        M.class_scores(cells, by, ["hits_k", "rr", "loss", "missed"])
        .groupBy(*by)
        .agg(
            total.alias("queries"),
            M.ratio(F.sum("hits"), total).alias("accuracy"),
            *[M.weighted(m).alias(m) for m in ("precision", "recall", "f1")],
            M.ratio(F.sum("rr"), total).alias("mrr"),
            M.ratio(F.sum("hits_k"), total).alias("topk_accuracy"),
            *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
            M.ratio(F.sum("loss"), total).alias("log_loss"),
            F.sum("missed").cast("bigint").alias("unscored"),
        )
    )


def evaluate_with_report(split: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """All metrics of a split table, and (class, precision, recall, f1, support) of each class, from one search."""
    scored = stage(score_queries(rows_of(split, "test"), rows_of(split, "train"), **options), "scored")
    scores = M.class_scores(M.confusion(scored))
    return evaluate(scored), scores.select("class", "precision", "recall", "f1", "support")


def evaluate_split(split: DataFrame, **options) -> DataFrame:
    """Index the train rows of a split table, score its test rows."""
    return evaluate(score_queries(rows_of(split, "test"), rows_of(split, "train"), **options))


def evaluate_few_shot(split: DataFrame, **options) -> DataFrame:
    """As `evaluate_split`, after the hold-out examples joined the index and the hold-out rows the test."""
    index = grow_index(rows_of(split, "train"), rows_of(split, "holdout_example"))
    return evaluate(score_queries(rows_of(split, "test", "holdout_test"), index, **options))


def compare_embeddings(split: DataFrame, models: dict[str, str], **options) -> DataFrame:
    """(model, metrics…): the same evaluation for several embedding columns of one table."""
    runs = [
        evaluate_split(split, vec_col=column, **options).withColumn("model", F.lit(name))
        for name, column in models.items()
    ]
    return union_all(runs)
