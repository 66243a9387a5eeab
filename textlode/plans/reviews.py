"""The review run: from raw rows to a stored split, model and scores, and its scorer on the same split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from textlode.operators import classify, clean, embed, labels, profile, splits


@dataclass
class ReviewRun:
    split: DataFrame  # id, text, label, label_id, split
    summary: DataFrame
    scores: DataFrame


def run_reviews(
    raw: DataFrame, folder: str, per_source: int = 100_000, sample: int = 20_000, test_size: float = 0.2, dim: int = 256
) -> ReviewRun:
    """Clean, cap per class, sample, profile, encode, split, embed, fit and score; `folder` keeps split, encoder and model.

    `raw` has id, text and label under these or their raw names. The split is written once and every later step, the scorer
    included, reads that table.
    """
    spark = raw.sparkSession
    corpus = clean.require_columns(clean.rename_columns(raw), ("id", "text", "label"))
    corpus = clean.trim_text(clean.drop_nulls(corpus))
    chosen = splits.sample_rows(splits.cap_per_source(corpus, per_source, "label"), sample)
    coded = splits.random_split(labels.encode_labels(chosen.select("id", "text", "label")), test_size)
    coded.select("id", "text", "label", "label_id", "split").write.mode("overwrite").parquet(f"{folder}/split")
    split = spark.read.parquet(f"{folder}/split")
    encoder = embed.fit_encoder(splits.rows_of(split, "train"), dim=dim)
    encoder.write().overwrite().save(f"{folder}/encoder")
    model = classify.fit_logistic(embed.embed(splits.rows_of(split, "train"), encoder))
    classify.save_model(model, f"{folder}/model")
    return ReviewRun(split, profile.corpus_summary(split), score_reviews(spark, folder))


def score_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of a stored model on the test rows of the split it was fitted on."""
    encoder = PipelineModel.load(f"{folder}/encoder")
    test = splits.rows_of(spark.read.parquet(f"{folder}/split"), "test")
    return classify.score(classify.load_model(f"{folder}/model"), embed.embed(test, encoder))
