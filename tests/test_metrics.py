from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from textlode.operators import metrics as M


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 4, (200, 2)))]
    return spark.createDataFrame(rows, "query_id bigint, label_id int, pred int")


def test_weighted_metrics_equal_the_evaluator(scored):
    got = M.weighted_metrics(scored).first()
    doubles = scored.select(F.col("label_id").cast("double").alias("label"), F.col("pred").cast("double").alias("prediction"))
    names = {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall", "f1": "f1"}
    for ours, theirs in names.items():
        assert got[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(doubles))


def test_macro_counts_labels_only_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 7), (1, 1)], "label_id int, pred int")
    got = M.macro_metrics(df).first()
    assert got.precision == pytest.approx((1 + 1 + 0) / 3)
    assert got.recall == pytest.approx((0.5 + 1 + 0) / 3)
    assert got.f1 == pytest.approx((2 / 3 + 1 + 0) / 3)


def test_report_rows(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label_id int, pred int")
    names = spark.createDataFrame([(0, "no"), (1, "yes")], "label_id int, label string")
    got = {r.name: r for r in M.class_report(df, names).collect()}
    assert set(got) == {"no", "yes", "accuracy", "macro avg", "weighted avg"}
    assert got["yes"].precision == 0.5 and got["yes"].support == 1
    assert got["accuracy"].f1 == pytest.approx(2 / 3) and got["macro avg"].support == 3
    assert got["weighted avg"].precision == pytest.approx((2 * 1 + 1 * 0.5) / 3)


def test_ranked_label_metrics(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [1, 2])], "label_id int, labels array<int>")
    assert M.topk_accuracy(df).first()[0] == pytest.approx(2 / 3)
    assert M.mean_reciprocal_rank(df).first()[0] == pytest.approx((1 + 0.5 + 0) / 3)


def test_log_loss_is_finite_at_zero(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.25, 0.75])], "label_id int, probabilities array<double>")
    got = M.log_loss(df, M.probability_of()).first()
    want = (-math.log(M.EPSILON) - math.log(0.75)) / 2
    assert got.log_loss == pytest.approx(want) and got.perplexity == pytest.approx(math.exp(want))


def test_majority_goes_to_the_smallest_of_equals(spark):
    train = spark.createDataFrame([(2,), (2,), (1,), (1,), (0,)], "label_id int")
    assert M.majority_class(train).first().pred == 1
    assert M.majority_baseline(train, spark.createDataFrame([(1,), (0,)], "label_id int")).first().accuracy == 0.5


def correlation_rows(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n).astype(float)
    x = np.round(rng.random(n) + y * 0.2, 2)
    x[: n // 3] = 1.0  # one value holds a third of all rows
    return pd.DataFrame({"pair_id": range(n), "similarity": x, "label": y})


def rank_correlation(pdf):
    return pdf.similarity.rank().corr(pdf.label.rank())


@pytest.mark.parametrize("forced", [False, True])
def test_correlation(spark, request, forced):
    if forced:
        request.getfixturevalue("no_broadcast")
    parts = [correlation_rows(400, s).assign(epoch=float(s), steps=100 * s) for s in (1, 2)]
    flat = correlation_rows(50, 3).assign(epoch=3.0, steps=300, label=1.0)
    df = spark.createDataFrame(pd.concat([*parts, flat]))
    got = {r.epoch: r for r in M.pair_correlation(df, ["epoch", "steps"]).collect()}
    for pdf in parts:
        row = got[pdf.epoch[0]]
        assert row.cosine_pearson == pytest.approx(pdf.similarity.corr(pdf.label))
        assert row.cosine_spearman == pytest.approx(rank_correlation(pdf))
    assert got[3.0].cosine_pearson is None and got[3.0].cosine_spearman is None


def test_pair_classifier_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.5, 1), (0.4999, 1), (0.1, 0)], "similarity double, label int")
    assert [r.pred for r in M.pair_predictions(df).orderBy("similarity").collect()] == [0, 0, 1]
    assert M.pair_classifier(df).first().accuracy == pytest.approx(2 / 3)
