"""Quality metrics of the neighbour vote and of drawn pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlode.operators import metrics as M
from textlode.operators.embed import pair_scores
from textlode.operators.pairs import labelled_pairs
from textlode.operators.scale import stage
from textlode.operators.splits import rows_of
from textlode.plans.catalog import sql
from textlode.plans.catalog.neighbours import rounded
from textlode.plans.catalog.registry import changed, embeddings, query, split_embeddings
from textlode.plans.evaluation import score_queries


def _scored(spark, folder):
    split = split_embeddings(spark, folder)
    return score_queries(rows_of(split, "test"), rows_of(split, "train"))


@query("m1_accuracy", f"WITH {sql.SCORED} SELECT round(avg(CASE WHEN label_id = pred THEN 1.0 ELSE 0 END), 6) AS accuracy FROM scored")
def m1(spark, folder):
    return rounded(M.accuracy(_scored(spark, folder)))


@query("m2_weighted_metrics", f"WITH {sql.SCORED}, {sql.class_scores()} SELECT {sql.WEIGHTED} FROM classes")
def m2(spark, folder):
    return rounded(M.weighted_metrics(_scored(spark, folder)))


@query(
    "m3_macro_metrics",
    f"""WITH {sql.SCORED}, {sql.class_scores()} SELECT round(sum(hits) / sum(support), 6) AS accuracy,
    round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM classes""",
)
def m3(spark, folder):
    return rounded(M.macro_metrics(_scored(spark, folder)))


@query(
    "m4_class_report",
    f"""WITH {sql.SCORED}, {sql.class_scores()}, rep AS (
    SELECT 'class ' || class AS name, p AS precision, r AS recall, f AS f1, support FROM classes
    UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM classes
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM classes
    UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
      sum(f * support) / sum(support), sum(support) FROM classes)
    SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
    FROM rep""",
)
def m4(spark, folder):
    names = embeddings(spark, folder).select("label_id").distinct()
    names = names.withColumn("label", F.concat_ws(" ", F.lit("class"), "label_id"))
    return rounded(M.class_report(_scored(spark, folder), names))


@query("m5_topk_accuracy", f"WITH {sql.SCORED} SELECT round(topk_accuracy, 6) AS topk_accuracy FROM (SELECT {sql.PER_QUERY} FROM scored)")
def m5(spark, folder):
    return rounded(M.topk_accuracy(_scored(spark, folder)))


@query("m6_mean_reciprocal_rank", f"WITH {sql.SCORED} SELECT round(mrr, 6) AS mrr FROM (SELECT {sql.PER_QUERY} FROM scored)")
def m6(spark, folder):
    return rounded(M.mean_reciprocal_rank(_scored(spark, folder)))


LOSS = f"""WITH {sql.SCORED}, l AS (SELECT avg(-ln(least(greatest(own_share, {M.EPSILON}::DOUBLE), 1 - {M.EPSILON}::DOUBLE))) AS loss
FROM scored)"""


@query("m7_log_loss", f"{LOSS} SELECT round(loss, 6) AS log_loss FROM l")
def m7(spark, folder):
    return rounded(M.log_loss(_scored(spark, folder), M.share_of()).select("log_loss"))


@query("m8_perplexity", f"{LOSS} SELECT CAST(printf('%.8e', exp(loss)) AS DOUBLE) AS perplexity FROM l")
def m8(spark, folder):
    # To nine digits: the vote gives the true class no share at all for most queries, so the value is large.
    loss = M.log_loss(_scored(spark, folder), M.share_of())
    return loss.select(F.format_string("%.8e", "perplexity").cast("double").alias("perplexity"))


@query(
    "m9_majority_baseline",
    f"""WITH {sql.VECS}, {sql.three_way('vecs', 'label_id')},
    top AS (SELECT label_id AS pred FROM split WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, label_id LIMIT 1),
    scored AS (SELECT label_id, pred FROM split, top WHERE split = 'val'), {sql.class_scores()}
    SELECT {sql.WEIGHTED} FROM classes""",
)
def m9(spark, folder):
    split = split_embeddings(spark, folder)
    return rounded(M.majority_baseline(rows_of(split, "train"), rows_of(split, "val")))


DRAWS = 5_000
PAIRS = f"{sql.VECS}, {sql.classes('vecs', 'label_id')}, {sql.labelled_pairs(DRAWS)}"


def _pairs(spark, folder):
    vectors = embeddings(spark, folder)
    return stage(labelled_pairs(vectors, DRAWS, label_col="label_id", text_col=None), "pairs"), vectors


@query(
    "m10_pair_classifier",
    f"""WITH {PAIRS}, near AS (SELECT pairs.label::INT AS label_id, list_cosine_similarity(a.v, b.v) AS similarity
      FROM pairs JOIN vecs a ON a.id = id_a JOIN vecs b ON b.id = id_b),
    scored AS (SELECT label_id, CASE WHEN similarity >= 0.1 THEN 1 ELSE 0 END AS pred FROM near), {sql.class_scores()},
    scored2 AS (SELECT label_id, CASE WHEN similarity >= 0.5 THEN 1 ELSE 0 END AS pred FROM near), {sql.class_scores('scored2', 'classes2')}
    SELECT 0.1::DOUBLE AS threshold, round(sum(hits) / sum(support), 6) AS accuracy, round(sum(f * support) / sum(support), 6) AS f1 FROM classes
    UNION ALL SELECT 0.5::DOUBLE, round(sum(hits) / sum(support), 6), round(sum(f * support) / sum(support), 6) FROM classes2""",
)
def m10(spark, folder):
    # The vectors carry no class signal, so the default threshold of 0.5 calls nearly all pairs different.
    pairs, vectors = _pairs(spark, folder)
    scored = stage(pair_scores(pairs, vectors, ["pair_id"]).withColumn("label", F.col("label").cast("int")), "scored")
    runs = [M.pair_classifier(scored, threshold=x).withColumn("threshold", F.lit(x)) for x in (0.1, 0.5)]
    return rounded(runs[0].unionByName(runs[1]))


@query(
    "m11_pair_correlation",
    f"""WITH {PAIRS}, versions AS (SELECT id, v, list_transform(v, lambda x, i: x * (1.0::DOUBLE + 0.1::DOUBLE * ((i - 1) % 3))) AS w FROM vecs),
    s AS (SELECT pairs.label AS y, list_cosine_similarity(a.v, b.v) AS x0, list_cosine_similarity(a.w, b.w) AS x1
      FROM pairs JOIN versions a ON a.id = id_a JOIN versions b ON b.id = id_b),
    e AS (SELECT 0.0::DOUBLE AS epoch, 0 AS steps, x0 AS x, y FROM s UNION ALL SELECT 1.0::DOUBLE, 100, x1, y FROM s
      UNION ALL SELECT 2.0::DOUBLE, 200, x1, 1.0 FROM s),
    r AS (SELECT *, rank() OVER (PARTITION BY epoch ORDER BY x) + (count(*) OVER (PARTITION BY epoch, x) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY epoch ORDER BY y) + (count(*) OVER (PARTITION BY epoch, y) - 1) / 2 AS ry FROM e)
    SELECT epoch, steps, CASE WHEN min(y) < max(y) THEN round(corr(x, y), 6) END AS cosine_pearson,
      CASE WHEN min(y) < max(y) THEN round(corr(rx, ry), 6) END AS cosine_spearman FROM r GROUP BY 1, 2""",
)
def m11(spark, folder):
    pairs, vectors = _pairs(spark, folder)

    def point(epoch, steps, versions):
        scored = pair_scores(pairs, versions, ["pair_id"])
        return scored.select(F.lit(epoch).alias("epoch"), F.lit(steps).alias("steps"), "pair_id", "similarity", "label")

    after = vectors.withColumn("embedding", changed())
    log = point(0.0, 0, vectors).unionByName(point(1.0, 100, after))
    constant = point(2.0, 200, after).withColumn("label", F.lit(1.0))
    result = M.pair_correlation(log.unionByName(constant), ["epoch", "steps"])
    return result.withColumns({c: F.round(c, 6) for c in ("cosine_pearson", "cosine_spearman")})
