"""Logistic regression on the embeddings.

SQL cannot state an iterative fit, so the queries return facts that hold for any right fit, which it can state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlode.functions import vectors as V
from textlode.operators import classify
from textlode.operators.scale import new_path, stage
from textlode.operators.splits import rows_of
from textlode.plans.catalog import sql
from textlode.plans.catalog.registry import query, split_embeddings

#: Largest part of a gradient that counts as 0. A model of intercepts alone has parts of about 1e-3.
FLAT = 2e-5
SPLIT = f"WITH {sql.VECS}, {sql.three_way('vecs', 'label_id')}"


def _fitted(spark, folder):
    split = split_embeddings(spark, folder)
    split = stage(split, "split")
    return classify.fit_logistic(rows_of(split, "train")), split


@query(
    "c1_logistic_regression",
    f"""{SPLIT}, shape AS (SELECT CAST(max(label_id) AS INTEGER) AS top, any_value(len(v)) AS dims FROM split WHERE split = 'train')
    SELECT CAST(unnest(range(top + 1)) AS INTEGER) AS label_id, component, true AS at_optimum
    FROM shape, (SELECT CAST(unnest(range(-1, dims)) AS INTEGER) AS component FROM shape)""",
)
def c1(spark, folder):
    """At the optimum the gradient of the penalised loss is 0 for every class and component, which holds for no other model."""
    model, split = _fitted(spark, folder)
    found = classify.gradient(model, rows_of(split, "train"))
    return found.select("label_id", "component", (F.abs("gradient") < FLAT).alias("at_optimum"))


@query("c2_predict_class", f"{SPLIT} SELECT id, label_id, true AS most_likely, true AS learnt FROM split WHERE split = 'test'")
def c2(spark, folder):
    model, split = _fitted(spark, folder)
    test = rows_of(split, "test")
    likely = classify.predict_probabilities(model, test).select("id", V.argmax("probabilities").alias("likely"))
    found = classify.predict_class(model, test).join(likely, "id")
    learnt = classify.has_learnt(model, rows_of(split, "train")).first()["learnt"]
    return found.select("id", "label_id", (F.col("pred") == F.col("likely")).alias("most_likely"), F.lit(learnt).alias("learnt"))


@query(
    "c3_predict_probabilities",
    f"""{SPLIT} SELECT id, label_id, (SELECT max(label_id) + 1 FROM split WHERE split = 'train') AS classes, 1.0::DOUBLE AS total, true AS learnt
    FROM split WHERE split = 'test'""",
)
def c3(spark, folder):
    model, split = _fitted(spark, folder)
    found = classify.predict_probabilities(model, rows_of(split, "test"))
    p = F.col("probabilities")
    learnt = classify.has_learnt(model, rows_of(split, "train")).first()["learnt"]
    return found.select("id", "label_id", F.size(p).alias("classes"), F.round(V.total(p), 6).alias("total"), F.lit(learnt).alias("learnt"))


@query("c5_score_stored_model", "SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'log_loss', 'perplexity']) AS metric, true AS same, true AS learnt")
def c5(spark, folder):
    model, split = _fitted(spark, folder)
    path = new_path(spark, "model")
    classify.save_model(model, path)
    names = ["accuracy", "precision", "recall", "f1", "log_loss", "perplexity"]
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])).alias("m")
    fresh, stored = (classify.score(m, rows_of(split, "test")).select(values).select("m.*") for m in (model, classify.load_model(path)))
    both = fresh.join(stored.withColumnRenamed("value", "again"), "metric")
    learnt = classify.has_learnt(classify.load_model(path), rows_of(split, "train")).first()["learnt"]
    return both.select("metric", (F.abs(F.col("value") - F.col("again")) <= 1e-9 * F.abs("value")).alias("same"), F.lit(learnt).alias("learnt"))


@query(
    "c6_grid_search_logistic",
    """SELECT row_number() OVER () AS run_idx, c, max_iter, true AS in_order, true AS is_share
    FROM (VALUES (0.1::DOUBLE, 5), (0.1::DOUBLE, 1000), (1.0::DOUBLE, 5), (1.0::DOUBLE, 1000)) AS grid(c, max_iter)""",
)
def c6(spark, folder):
    split = split_embeddings(spark, folder)
    grid = {"c": [0.1, 1.0], "max_iter": [5, 1000]}
    found = classify.search_logistic(rows_of(split, "train"), rows_of(split, "val"), grid)
    # Four rows: each with the best of all that follow it.
    rows = found.agg(F.collect_list(F.struct("run_idx", "c", "max_iter", "f1")).alias("rows"))
    placed = rows.select("rows", F.posexplode("rows").alias("at", "r"))
    later = F.array_max(F.transform(F.slice("rows", F.col("at") + 1, 4), lambda x: x["f1"]))
    return placed.select(
        F.col("r.run_idx").cast("bigint").alias("run_idx"), "r.c", "r.max_iter", (F.col("r.f1") >= later).alias("in_order"),
        F.col("r.f1").between(0, 1).alias("is_share"),
    )
