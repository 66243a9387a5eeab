"""The registered facts turn false for models that have learnt nothing and axes that are not the principal ones; ranks, ids, sketches, sources."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlode.operators import classify, clean, embed, metrics, profile
from textlode.plans.catalog import classifiers, vectors
from textlode.sources import readers

FOLDER = "/root/testdata/sf0.001"


def truths(df):
    return {c: all(r[c] for r in df.collect()) for c, kind in df.dtypes if kind == "boolean"}


@pytest.mark.parametrize("strength", [None, 1e-9])
def test_facts_of_classifiers_depend_on_the_fit(spark, monkeypatch, strength):
    """With so strong a penalty only the intercepts are left; such a model must not pass."""
    fit = classify.fit_logistic
    if strength:

        def intercepts(train, *args, **options):
            model = fit(train, c=strength)
            model.set(model.regParam, 1.0 / max(train.count(), 1))
            return model

        monkeypatch.setattr(classify, "fit_logistic", intercepts)
    good = strength is None
    assert truths(classifiers.c1(spark, FOLDER))["at_optimum"] == good
    assert truths(classifiers.c2(spark, FOLDER))["learnt"] == good
    assert truths(classifiers.c3(spark, FOLDER))["learnt"] == good
    assert truths(classifiers.c5(spark, FOLDER))["learnt"] == good


def test_narrow_axes_turn_the_projection_false(spark, monkeypatch):
    assert all(truths(vectors.v9(spark, FOLDER)).values())
    project = embed.project_2d

    def narrow(versions, **options):
        out = project(versions, **options).drop("x", "y")
        parts = []
        for name, df in versions.items():
            rows = df.select("id", F.col("embedding").cast("array<double>").alias("v")).collect()
            x = np.array([r["v"] for r in rows])
            axes = np.linalg.eigh(np.cov(x.T))[1][:, :2] @ np.array([[0, 1], [1, 0]])
            parts += [(name, r["id"], float(a), float(b)) for r, (a, b) in zip(rows, x @ axes, strict=True)]
        return out.join(spark.createDataFrame(parts, "stage string, id bigint, x double, y double"), ["stage", "id"])

    monkeypatch.setattr(embed, "project_2d", narrow)
    found = truths(vectors.v9(spark, FOLDER))
    assert found["x_is_axis"] and found["y_is_axis"] and not found["two_widest"]

    def tilted(versions, **options):
        return project(versions, **options).selectExpr("stage", "id", "label", "0.8 * x + 0.6 * y AS x", "0.8 * y - 0.6 * x AS y")

    monkeypatch.setattr(embed, "project_2d", tilted)
    found = truths(vectors.v9(spark, FOLDER))
    assert not (found["x_is_axis"] and found["y_is_axis"])


def test_constant_encoder_turns_the_query_false(spark, monkeypatch):
    assert truths(vectors.v3(spark, FOLDER).drop("is_query")) == {"as_expected": True, "told_apart": True}
    constant = F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")
    monkeypatch.setattr(embed, "embed", lambda df, *_: df.withColumn("embedding", constant))
    assert truths(vectors.v3(spark, FOLDER).select("told_apart")) == {"told_apart": False}


def test_similarity_to_a_query_without_vector_is_null(spark):
    df = spark.createDataFrame([(1, "red apple"), (2, None)], "id bigint, text string")
    model = embed.hashing_model()
    rows = embed.embed_with(df, model)
    got = {r.id: r.similarity for r in embed.similar_to(rows, embed.embed_query_with(spark, "red apple", model)).collect()}
    assert got[1] == pytest.approx(1.0, abs=1e-6) and got[2] is None
    assert [r.similarity for r in embed.similar_to(rows, embed.embed_query_with(spark, "  ", model)).collect()] == [None, None]


def test_external_encoder_keeps_vectors_at_their_ids(spark):
    rows = [(i, t) for i, t in enumerate(["a b", None, " ", "b a", "c " * 500, "a a a", "a b c"])]
    df = spark.createDataFrame(rows, "id int, text string")
    found = {r["id"]: r["embedding"] for r in embed.embed_with(df, embed.hashing_model(32), batch_size=2).collect()}
    assert found[1] is None and found[2] is None and found[0] == found[3] and found[0] != found[6]
    assert sum(x != 0 for x in found[4]) == 1 and abs(sum(x * x for x in found[5]) - 1) < 1e-6


@pytest.mark.parametrize("kind", ["ties", "constant", "border"])
def test_average_ranks_carry_ties_across_ranges(spark, kind):
    rng = random.Random(1)
    value = {"ties": lambda i: rng.choice([0, 0, 0, 1, rng.random()]), "constant": lambda i: 2.0, "border": lambda i: i // 70}[kind]
    rows = [(rng.choice(["a", "b", None]), float(value(i)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x double, id int").repartition(6)
    found = metrics.with_average_rank(df, "x", ["g"], "r").collect()
    assert len(found) == len(rows)
    for g in ("a", "b", None):
        own = sorted(x for h, x, _ in rows if h == g)
        for r in (r for r in found if r["g"] == g):
            places = [i + 1 for i, x in enumerate(own) if x == r["x"]]
            assert r["r"] == sum(places) / len(places)


def test_correlation_joins_no_values(spark):
    df = spark.createDataFrame([(i % 2, i / 7, float(i % 3)) for i in range(90)], "e int, similarity double, label double")
    plan = metrics.pair_correlation(df, ["e"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_range" in line for line in joins)


def test_batches_shuffle_vectors_once(spark):
    rows = [(i, [float(i), 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    members = embed.batch_members(df, ["embedding"], 16)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    found = members.collect()
    assert sorted(len(r["members"]) for r in found) == [8] + [16] * 12
    assert sorted(m["id"] for r in found for m in r["members"]) == list(range(200))
    want = {r["id"]: r["batch"] for r in embed.shuffled_batches(df, 16).collect()}
    assert all(want[m["id"]] == r["batch"] for r in found for m in r["members"])


def test_batches_across_runs(spark, monkeypatch):
    monkeypatch.setattr(embed, "RUN_BATCHES", 2)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(333)], "id bigint, embedding array<double>")
    want = {r["id"]: r["batch"] for r in embed.shuffled_batches(df, 5).collect()}
    found = {m["id"]: r["batch"] for r in embed.batch_members(df, ["embedding"], 5).collect() for m in r["members"]}
    assert found == want


def test_sketch_stays_within_its_bound(spark):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(30_000)]
    df = spark.createDataFrame([(" ".join(words[i : i + 30]),) for i in range(0, len(words), 30)], "text string").repartition(5)
    exact = {w: words.count(w) for w in set(words)}
    found = profile.heavy_words(df, 10, 256).collect()
    assert len(found) == 10
    assert all(abs(r["estimate"] - exact[r["word"]]) <= r["bound"] for r in found)
    assert found[0]["bound"] < 500 and profile.heavy_words(df.where("false")).count() == 0


def test_row_ids_of_copies(spark):
    rows = [("same", 1)] * 50 + [(None, None), (None, None), ("", None), ("a", 2)]
    df = spark.createDataFrame(rows, "text string, n int")
    once = sorted(tuple(r) for r in clean.with_row_id(df, chunk=7).collect())
    again = sorted(tuple(r) for r in clean.with_row_id(df.repartition(9)).collect())
    assert once == again and len({r[0] for r in once}) == len(rows)
    assert sorted(map(str, (r[1:] for r in once))) == sorted(map(str, rows))


def test_sources_in_one_scan(spark, tmp_path):
    for name, lines in {"a b": ['{"t": "x"}', "no json"], "a b/c+d": ['{"t": "y"}'] * 3, "empty": [], "bad": ["{", "}"]}.items():
        (tmp_path / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / name / "part.json").write_text("".join(x + "\n" for x in lines))
    (tmp_path / "single.json").write_text(json.dumps({"t": "z"}) + "\n")
    paths = {n: f"{tmp_path}/{n}" for n in ("a b", "a b/c+d", "empty", "bad", "absent")} | {"single": f"file://{tmp_path}/singl?.json"}
    rows, status = readers.read_sources(spark, paths, "t string")
    assert sorted((r["t"], r["main_category"]) for r in rows.collect()) == [("x", "a b")] + [("y", "a b/c+d")] * 3 + [("z", "single")]
    want = {"a b": ("read", 1, 1), "a b/c+d": ("read", 3, 0), "empty": ("read", 0, 0), "bad": ("read", 0, 2), "absent": ("missing", 0, 0), "single": ("read", 1, 0)}
    assert {r["source"]: tuple(r)[1:] for r in status.collect()} == want
    for df in (rows, status):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
