"""Embeddings, similarities, drift, token ids and TF-IDF."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textlode.functions import vectors as V
from textlode.operators import embed
from textlode.operators.scale import stage
from textlode.operators.tfidf import pair_similarity, tfidf
from textlode.plans.catalog import sql
from textlode.plans.catalog.registry import changed, documents, embeddings, query

DIM = 256


@query("v1_text_embed", f"WITH {sql.DOCS} SELECT id, {DIM} AS dims, true AS unit, true AS like_its_copies FROM docs")
def v1(spark, folder):
    """The encoder's hash is Spark's own, so SQL states what holds for any hash: length, unit norm, equal texts alike."""
    docs = documents(spark, folder).select("id", "text")
    vectors = embed.embed(docs, embed.fit_encoder(docs, dim=DIM)).select("id", F.md5("text").alias("digest"), "embedding")
    vectors = stage(vectors, "embedded")
    copies = vectors.groupBy("digest").agg(F.count_distinct(F.coalesce("embedding", F.array())).alias("versions"))
    return vectors.join(copies, "digest").select(
        "id",
        F.when(F.col("embedding").isNull(), DIM).otherwise(F.size("embedding")).alias("dims"),
        F.coalesce(F.abs(V.norm("embedding") - 1.0) < 1e-4, F.lit(True)).alias("unit"),
        (F.col("versions") == 1).alias("like_its_copies"),
    )


HASH_DIM = 16
HASHED = f"""words AS (SELECT id, md5(unnest({sql.words('text')})) AS m FROM docs),
    hits AS (SELECT id, CAST('0x' || substr(m, 1, 8) AS BIGINT) % {HASH_DIM} AS pos, 1 - 2 * (CAST('0x' || substr(m, 9, 1) AS BIGINT) % 2) AS sign FROM words),
    sums AS (SELECT id, pos, sum(sign)::DOUBLE AS value FROM hits GROUP BY 1, 2),
    norms AS (SELECT id, sqrt(sum(value * value)) AS len FROM sums GROUP BY 1)"""


@query(
    "v1_external_encoder",
    f"""WITH {sql.DOCS}, {HASHED}
    SELECT n.id, p.pos, round(CAST(CAST(coalesce(value, 0.0::DOUBLE) / len AS FLOAT) AS DOUBLE), 6) AS value
    FROM norms n CROSS JOIN (SELECT unnest(range({HASH_DIM})) AS pos) p LEFT JOIN sums s ON s.id = n.id AND s.pos = p.pos WHERE len > 0""",
)
def v1_external(spark, folder):
    """A model from outside, run in batches on the executors; this one's values can be stated in SQL."""
    vectors = embed.embed_with(documents(spark, folder), embed.hashing_model(HASH_DIM))
    values = vectors.select("id", F.posexplode("embedding").alias("pos", "value"))
    return values.select("id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query(
    "v2_l2_normalize",
    f"""WITH {sql.VECS}, s AS (SELECT id, list_transform(v, lambda x: x * (label_id + 2)) AS v FROM vecs),
    n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM s)
    SELECT id, unnest(range(len(v))) AS pos, round(unnest(list_transform(v, lambda x: x / len)), 6) AS value FROM n""",
)
def v2(spark, folder):
    stretch = F.transform("embedding", lambda x: x.cast("double") * (F.col("label_id") + 2))
    unit = embed.normalize_embeddings(embeddings(spark, folder).withColumn("embedding", stretch))
    return unit.select("id", F.posexplode("embedding").alias("pos", "value")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


QUERY = "one AS (SELECT id AS query_id, text AS query FROM docs WHERE length(text) > 200 ORDER BY id LIMIT 1)"


def _query_text(docs):
    return docs.where(F.length("text") > 200).orderBy("id").select("text").first()["text"]


@query(
    "v3_embed_query",
    f"WITH {sql.DOCS}, {QUERY} SELECT id, coalesce(text = query, false) AS is_query, true AS as_expected, true AS told_apart FROM docs CROSS JOIN one",
)
def v3(spark, folder):
    """The query is the text of a document: of all documents it and its copies have similarity 1, and the encoder tells others apart."""
    docs = documents(spark, folder).select("id", "text")
    encoder = embed.fit_encoder(docs, dim=DIM)
    text = _query_text(docs)
    found = embed.similar_to(embed.embed(docs, encoder), embed.embed_query(docs, text, encoder))
    found = stage(found.select("id", F.coalesce(F.col("text") == text, F.lit(False)).alias("is_query"), "similarity"), "similar")
    least = found.agg(F.min("similarity")).scalar()
    size = F.abs("similarity")
    expected = F.when(F.col("is_query"), F.abs(size - 1) < 1e-6).otherwise(F.col("similarity").isNull() | (size < 1 + 1e-6))
    return found.select("id", "is_query", F.coalesce(expected, F.lit(False)).alias("as_expected"), (least < 0.9).alias("told_apart"))


@query(
    "v3_external_query",
    f"""WITH {sql.DOCS}, {QUERY}, {HASHED},
    units AS (SELECT id, pos, CAST(CAST(value / len AS FLOAT) AS DOUBLE) AS value FROM sums JOIN norms USING (id) WHERE len > 0),
    lens AS (SELECT id, sqrt(sum(value * value)) AS len FROM units GROUP BY 1),
    q AS (SELECT pos, value AS other FROM units JOIN one ON id = query_id),
    dots AS (SELECT id, sum(value * coalesce(other, 0)) AS dot FROM units LEFT JOIN q USING (pos) GROUP BY 1)
    SELECT id, CASE WHEN abs(dot) < 4e-7 THEN 0.0::DOUBLE ELSE round(dot / len / (SELECT sqrt(sum(other * other)) FROM q), 6) END AS similarity
    FROM docs LEFT JOIN dots USING (id) LEFT JOIN lens USING (id)""",
)
def v3_external(spark, folder):
    """One query text against all documents, both by a model from outside; the values can be stated in SQL."""
    docs = documents(spark, folder).select("id", "text")
    model = embed.hashing_model(HASH_DIM)
    found = embed.similar_to(embed.embed_with(docs, model), embed.embed_query_with(spark, _query_text(docs), model))
    return found.select("id", F.round("similarity", 6).alias("similarity"))


NEXT = "p AS (SELECT a.id AS id_a, b.id AS id_b, a.v AS va, b.v AS vb FROM vecs a JOIN vecs b ON b.id = a.id + 1)"


def _next_pairs(spark, folder):
    """Each vector with the one that follows it."""
    vectors = embeddings(spark, folder)
    ids = vectors.select("id")
    pairs = ids.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    pairs = pairs.join(ids.withColumnRenamed("id", "id_b"), "id_b", "left_semi")
    return embed.pair_scores(pairs, vectors, ["id_a", "id_b"])


@query(
    "v4_squared_distance",
    f"WITH {sql.VECS}, {NEXT} SELECT id_a, id_b, round(list_distance(va, vb) ^ 2, 6) AS dist FROM p",
)
def v4(spark, folder):
    return _next_pairs(spark, folder).select("id_a", "id_b", F.round("dist", 6).alias("dist"))


@query(
    "v5_cosine",
    f"WITH {sql.VECS}, {NEXT} SELECT id_a, id_b, round(list_cosine_similarity(va, vb), 6) AS similarity FROM p",
)
def v5(spark, folder):
    return _next_pairs(spark, folder).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


BATCHES = f"""b AS (SELECT *, (row_number() OVER (ORDER BY {sql.key('batch')}, id) - 1) // 16 AS batch FROM vecs)"""


@query(
    "v6_batch_similarity",
    f"""WITH {sql.VECS}, {BATCHES} SELECT x.batch, x.id, y.id AS other, round(list_cosine_similarity(x.v, y.v), 6) AS similarity
    FROM b x JOIN b y ON x.batch = y.batch""",
)
def v6(spark, folder):
    rows = embed.batch_similarity(embeddings(spark, folder))
    cells = F.explode(F.arrays_zip("ids", "similarities")).alias("c")
    return rows.select("batch", "id", cells).select(
        "batch", "id", F.col("c.ids").alias("other"), F.round("c.similarities", 6).alias("similarity")
    )


CHANGED = "list_transform(v, lambda x, i: x * (1.0::DOUBLE + 0.1::DOUBLE * ((i - 1) % 3)))"


@query(
    "v7_embedding_drift",
    f"""WITH {sql.VECS}, {BATCHES}, c AS (SELECT *, {CHANGED} AS w FROM b),
    s AS (SELECT x.batch, x.id, list_cosine_similarity(x.v, y.v) / 2 AS p, list_cosine_similarity(x.w, y.w) / 2 AS q
      FROM c x JOIN c y ON x.batch = y.batch),
    n AS (SELECT batch, id, ln(sum(exp(p))) AS lp, ln(sum(exp(q))) AS lq FROM s GROUP BY 1, 2),
    k AS (SELECT batch, id, sum(exp(p - lp) * ((p - lp) - (q - lq))) AS kl FROM s JOIN n USING (batch, id) GROUP BY 1, 2)
    SELECT batch, count(*) AS rows, round(avg(kl), 6) AS kl FROM k GROUP BY 1""",
)
def v7(spark, folder):
    versions = embeddings(spark, folder).withColumn("after", changed())
    return embed.embedding_drift(versions, "embedding", "after").withColumn("kl", F.round("kl", 6))


@query(
    "v8_token_ids",
    f"""WITH {sql.DOCS}, t AS (SELECT id, {sql.words('lower(text)')} AS words FROM docs),
    vocab AS (SELECT word, 1 + row_number() OVER (ORDER BY count(*) DESC, word) AS token FROM (SELECT unnest(words) AS word FROM t) GROUP BY 1),
    p AS (SELECT id, unnest(words[1:256]) AS word, generate_subscripts(words[1:256], 1) AS place FROM t),
    ids AS (SELECT id, list(coalesce(token, 1) ORDER BY place) AS ids FROM p LEFT JOIN vocab USING (word) GROUP BY 1)
    SELECT t.id, array_to_string(list_concat(coalesce(ids, []), list_transform(range(256 - len(coalesce(ids, []))), lambda x: 0)), ' ')
      AS input_ids, len(coalesce(ids, [])) AS tokens FROM t LEFT JOIN ids USING (id)""",
)
def v8(spark, folder):
    rows = embed.token_ids(documents(spark, folder))
    mask = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return rows.select("id", F.array_join("input_ids", " ").alias("input_ids"), mask.cast("bigint").alias("tokens"))


@query(
    "v9_projection_2d",
    """SELECT unnest(['before', 'after']) AS stage, least(2000, count(*)) AS rows, true AS uncorrelated, true AS x_is_axis, true AS y_is_axis,
      true AS two_widest FROM embeddings""",
)
def v9(spark, folder):
    """Facts that only the two principal axes have.

    With C the covariance matrix, a unit vector v is an axis if and only if C v is as long as the variance along v, v'Cv. C v is the covariance of the
    components with the projection, so both are aggregates. The variances have to be the two largest that the sample has.
    """
    vectors = embeddings(spark, folder)
    versions = {"before": vectors, "after": vectors.withColumn("embedding", changed())}
    found = stage(embed.project_2d(versions, label_col="label_id"), "projected")
    all_vectors = [df.select(F.lit(name).alias("stage"), "id", F.col("embedding").cast("array<double>").alias("v")) for name, df in versions.items()]
    rows = stage(found.join(all_vectors[0].unionByName(all_vectors[1]), ["stage", "id"]), "with-vectors")
    cells = rows.select("stage", "x", "y", F.posexplode("v").alias("pos", "value"))
    along = cells.groupBy("stage", "pos").agg(F.covar_pop("value", "x").alias("cx"), F.covar_pop("value", "y").alias("cy"))
    along = along.groupBy("stage").agg(F.sqrt(F.sum(F.col("cx") ** 2)).alias("cx"), F.sqrt(F.sum(F.col("cy") ** 2)).alias("cy"))
    # At most 2,000 rows a version, as the projection takes a sample of so many.
    widest = {name: np.linalg.eigvalsh(np.cov(_matrix(rows.where(F.col("stage") == name)).T, bias=True))[-2:] for name in versions}
    table = spark.createDataFrame([(name, float(a), float(b)) for name, (b, a) in widest.items()], "stage string, first double, second double")
    facts = found.groupBy("stage").agg(
        F.count_distinct("id").alias("rows"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")
    )
    facts = facts.join(along, "stage").join(table, "stage")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-6 * F.col("first")
    return facts.select(
        "stage", "rows", (F.abs("c") < 1e-6).alias("uncorrelated"), near("cx", "vx").alias("x_is_axis"), near("cy", "vy").alias("y_is_axis"),
        (near("vx", "first") & near("vy", "second")).alias("two_widest"),
    )


def _matrix(rows):
    return np.array([r["v"] for r in rows.select("v").collect()])


@query("v10_tfidf", f"WITH {sql.DOCS}, {sql.tfidf()} SELECT id, term, round(weight, 6) AS weight FROM weights")
def v10(spark, folder):
    weights = tfidf(documents(spark, folder))
    return weights.select("id", "term", F.round("weight", 6).alias("weight"))


@query(
    "v10_tfidf_cosine",
    f"""WITH {sql.DOCS}, {sql.tfidf()}, p AS (SELECT a.id AS id_a, b.id AS id_b FROM docs a JOIN docs b ON b.id = a.id + 1),
    l AS MATERIALIZED (SELECT id_a, id_b, a.term, a.weight FROM p JOIN weights a ON a.id = id_a),
    s AS (SELECT id_a, id_b, sum(l.weight * b.weight) AS similarity FROM l JOIN weights b ON b.id = id_b AND b.term = l.term
      GROUP BY 1, 2)
    SELECT id_a, id_b, round(coalesce(similarity, 0), 6) AS similarity FROM p LEFT JOIN s USING (id_a, id_b)""",
)
def v10_cosine(spark, folder):
    docs = documents(spark, folder)
    following = docs.select((F.col("id") - 1).alias("id_a"), F.col("id").alias("id_b"))
    pairs = stage(following.join(docs.select(F.col("id").alias("id_a")), "id_a", "left_semi"), "next")
    scored = pair_similarity(docs, pairs, ["id_a", "id_b"], "id", "text")
    return scored.select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query(
    "c4_argmax",
    "SELECT vec_id AS id, list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings",
)
def c4(spark, folder):
    vectors = embeddings(spark, folder)
    return vectors.select("id", V.argmax("embedding").alias("pred"))
