from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlode.functions import vectors as V
from textlode.operators import classify, embed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("label_id")
    )


def test_vector_arithmetic(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = df.select(
        V.l2_normalize("a").alias("unit"), V.squared_distance("a", "b").alias("d"), V.cosine("a", "b").alias("c"), V.argmax("b").alias("m")
    ).collect()
    assert got[0].unit == [0.6, 0.8] and got[0].d == 20.0 and got[0].c == 0.6 and got[0].m == 0
    assert got[1].unit is None and got[1].c is None and got[1].m == 1


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "probabilities array<double>")
    assert classify.argmax_class(df).first().pred == 1


def test_encoder(spark):
    texts = ["red apple red", "green pear", "   ", None, "red apple red"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    encoder = embed.fit_encoder(df, dim=64)
    got = {r.id: r.embedding for r in embed.embed(df, encoder).collect()}
    assert set(got) == set(range(5)) and got[2] is None and got[3] is None
    assert got[0] == got[4] and len(got[0]) == 64
    assert math.sqrt(sum(x * x for x in got[0])) == pytest.approx(1, abs=1e-6)
    assert embed.embed_query(df, "red apple red", encoder).first().embedding == got[0]


def test_external_model_keeps_vectors_with_their_ids(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "", "b", None, " ", "cccc"])], "id bigint, text string")

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = {r.id: r.embedding for r in embed.embed_with(df.repartition(2), load, batch_size=2).collect()}
    assert got[1] is None and got[3] is None and got[4] is None
    for i, n in ((0, 2), (2, 1), (5, 4)):
        assert got[i] == pytest.approx([n / math.hypot(n, 1), 1 / math.hypot(n, 1)])


def test_batches_have_the_asked_size(vectors):
    sizes = sorted(r["count"] for r in embed.shuffled_batches(vectors, 16).groupBy("batch").count().collect())
    n = vectors.count()
    assert sizes == sorted([16] * (n // 16) + ([n % 16] if n % 16 else []))


def test_drift(spark, vectors):
    same = embed.embedding_drift(vectors.withColumn("after", F.col("embedding")), "embedding", "after")
    assert same.agg(F.max(F.abs("kl"))).first()[0] == pytest.approx(0, abs=1e-12)
    turned = vectors.withColumn("after", F.transform("embedding", lambda x, i: x * (1.0 + i)))
    got = {r.batch: (r.rows, r.kl) for r in embed.embedding_drift(turned, "embedding", "after", 8).collect()}
    rows = {r.id: r for r in turned.collect()}
    members = {}
    for r in embed.shuffled_batches(turned, 8).collect():
        members.setdefault(r.batch, []).append(r.id)
    for batch, ids in members.items():
        p, q = (np.array([rows[i][c] for i in ids], dtype=float) for c in ("embedding", "after"))
        soft = []
        for m in (p, q):
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
            e = np.exp(m @ m.T / 2.0)
            soft.append(e / e.sum(axis=1, keepdims=True))
        want = (soft[0] * np.log(soft[0] / soft[1])).sum() / len(ids)
        assert got[batch] == (len(ids), pytest.approx(want, rel=1e-6, abs=1e-9))


def test_token_ids(spark):
    df = spark.createDataFrame([(1, "b a a c"), (2, "a b x y"), (3, ""), (4, None)], "id bigint, text string")
    got = {r.id: r for r in embed.token_ids(df, max_length=3, vocabulary=2).collect()}
    assert got[1].input_ids == [3, 2, 2] and got[1].attention_mask == [1, 1, 1]
    assert got[2].input_ids == [2, 3, 1]
    assert got[3].input_ids == [0, 0, 0] and got[4].attention_mask == [0, 0, 0]


def test_projection_keeps_the_variance(vectors):
    got = embed.project_2d({"before": vectors, "after": vectors}, sample=200, label_col="label_id").toPandas()
    assert got.groupby("stage").size().to_dict() == {"before": 200, "after": 200}
    before = got[got.stage == "before"].sort_values("id")
    rows = {r.id: r.embedding for r in vectors.collect()}
    m = np.array([rows[i] for i in before.id], dtype=float)
    values = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1][:2]
    assert [before.x.var(), before.y.var()] == pytest.approx(list(values), rel=1e-6)


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_logistic_regression_minimises_the_penalised_loss(spark, vectors, tmp_path):
    model = classify.fit_logistic(vectors)
    rows = vectors.orderBy("id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    y = np.array([r.label_id for r in rows])
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    # Gradient of sum(log loss) + |w|^2 / 2, which is the loss at C = 1.
    gap = softmax(x @ w.T + b) - np.eye(len(b))[y]
    assert np.abs(gap.T @ x + w).max() < 0.05 and np.abs(gap.sum(axis=0)).max() < 0.05
    scored = {r.id: r for r in classify.predict(model, vectors).collect()}
    p = softmax(x @ w.T + b)
    for r, probabilities in zip(rows, p):
        assert scored[r.id].probabilities == pytest.approx(list(probabilities), abs=1e-9)
        assert scored[r.id].pred == probabilities.argmax()
    got = classify.score(model, vectors).first()
    assert got.accuracy == pytest.approx((p.argmax(axis=1) == y).mean())
    assert got.log_loss == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean())
    assert got.perplexity == pytest.approx(math.exp(got.log_loss))
    classify.save_model(model, str(tmp_path / "m"))
    again = classify.load_model(str(tmp_path / "m"))
    assert (again.coefficientMatrix.toArray() == w).all()


def test_search_keeps_every_combination(vectors):
    train, val = vectors.where("id % 2 = 0"), vectors.where("id % 2 = 1")
    got = classify.search_logistic(train, val, {"c": [0.1, 1.0], "max_iter": [5]}).collect()
    assert {(r.c, r.max_iter) for r in got} == {(0.1, 5), (1.0, 5)} and got[0].f1 >= got[1].f1
    assert {r.k for r in classify.search_k(train, val, [1, 5]).collect()} == {1, 5}


def test_review_run_and_its_scorer_use_one_split(spark, corpus, tmp_path):
    from textlode.plans.reviews import run_reviews, score_reviews

    raw = corpus.withColumnsRenamed({"text": "reviewText", "label": "main_category"})
    run = run_reviews(raw, str(tmp_path / "run"), per_source=80, sample=300, dim=32)
    rows = run.split.collect()
    assert len(rows) == 300 and sum(r.split == "test" for r in rows) == 60
    again = score_reviews(spark, str(tmp_path / "run")).first()
    assert again == run.scores.first() and 0 <= again.accuracy <= 1
    assert run.summary.count() >= 1
