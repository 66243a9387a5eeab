"""Quality metrics, finished on one small confusion aggregate.

Undefined ratios are 0 and averages run over all labels seen in truth or prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlode.operators.scale import join_null_safe, stage

# Fixed value: machine epsilon of a double, the usual clipping of probabilities.
EPSILON = 2.220446049250313e-16


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def confusion(scored: DataFrame, label: str = "label_id", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """(by…, label, pred, n)."""
    return scored.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_scores(table: DataFrame, by: list[str] = (), carry: list[str] = ()) -> DataFrame:
    """(by…, class, support, predicted, hits, precision, recall, f1) from a confusion table.

    Further sums in the columns `carry` go with the true class, so they need no pass of their own. A null prediction is
    no class: it only counts in its true class's support.
    """
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(zero)

    def side(name, support, predicted, hits, keep):
        extra = [(F.col(c) if keep else F.lit(0.0)).alias(c) for c in carry]
        return F.struct(
            F.col(name).alias("class"),
            support.alias("support"),
            predicted.alias("predicted"),
            hits.alias("hits"),
            *extra,
        )

    sides = F.array(side("label", F.col("n"), zero, hit, True), side("pred", zero, F.col("n"), zero, False))
    rows = table.select(*by, F.explode(sides).alias("c")).select(*by, "c.*")
    rows = rows.where(F.col("class").isNotNull() | (F.col("support") > 0))
    sums = rows.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits", *carry)])
    support, predicted, hits = F.col("support"), F.col("predicted"), F.col("hits")
    return sums.withColumns(
        {
            "precision": ratio(hits, predicted),
            "recall": ratio(hits, support),
            "f1": ratio(2.0 * hits, support + predicted),
        }
    )


def weighted(col: str) -> Column:
    return ratio(F.sum(F.col(col) * F.col("support")), F.sum("support"))


def accuracy(scored: DataFrame, label: str = "label_id", pred: str = "pred") -> DataFrame:
    return scored.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def weighted_metrics(scored: DataFrame, label: str = "label_id", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """(by…, accuracy, precision, recall, f1), classes weighted by support."""
    scores = class_scores(confusion(scored, label, pred, by), by)
    return scores.groupBy(*by).agg(
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[weighted(m).alias(m) for m in ("precision", "recall", "f1")],
    )


def macro_metrics(scored: DataFrame, label: str = "label_id", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """(by…, accuracy, precision, recall, f1), plain means over classes."""
    scores = class_scores(confusion(scored, label, pred, by), by)
    return scores.groupBy(*by).agg(
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")],
    )


def class_report(
    scored: DataFrame, names: DataFrame | None = None, label: str = "label_id", pred: str = "pred"
) -> DataFrame:
    """(name, precision, recall, f1, support): one row per class, then accuracy and the two averages.

    A rollup gives the class rows and the total row in one pass; the total row becomes the summary rows.
    `names` is a label dictionary.
    """
    scores = class_scores(confusion(scored, label, pred))
    rolled = scores.rollup("class").agg(
        F.grouping("class").alias("is_total"),
        F.sum("support").alias("support"),
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")],
        *[weighted(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
    )
    if names is None:
        rolled = rolled.withColumn("label", F.col("class").cast("string"))
    else:
        rolled = rolled.join(names.select(F.col("label_id").alias("class"), "label"), "class", "left")

    def row(name: Column, precision: str, recall: str, f1: str) -> Column:
        return F.struct(
            name.alias("name"),
            F.col(precision).alias("precision"),
            F.col(recall).alias("recall"),
            F.col(f1).alias("f1"),
            F.col("support"),
        )

    summary = F.array(
        row(F.lit("accuracy"), "accuracy", "accuracy", "accuracy"),
        row(F.lit("macro avg"), "precision", "recall", "f1"),
        row(F.lit("weighted avg"), "weighted_precision", "weighted_recall", "weighted_f1"),
    )
    per_class = F.array(row(F.col("label"), "precision", "recall", "f1"))
    return rolled.select(F.explode(F.when(F.col("is_total") == 1, summary).otherwise(per_class)).alias("r")).select(
        "r.*"
    )


def hit(labels: str = "labels", label: str = "label_id") -> Column:
    return F.array_contains(labels, F.col(label)).cast("double")


def reciprocal_rank(labels: str = "labels", label: str = "label_id") -> Column:
    """1 / position of the true label, 0 if it is absent."""
    return ratio(F.lit(1.0), F.nullif(F.array_position(F.col(labels), F.col(label)), F.lit(0)))


def topk_accuracy(scored: DataFrame, labels: str = "labels", label: str = "label_id") -> DataFrame:
    return scored.agg(F.avg(hit(labels, label)).alias("topk_accuracy"))


def mean_reciprocal_rank(scored: DataFrame, labels: str = "labels", label: str = "label_id") -> DataFrame:
    return scored.agg(F.avg(reciprocal_rank(labels, label)).alias("mrr"))


def clipped_loss(probability: Column) -> Column:
    """-ln of the probability of the true class, clipped away from 0 and 1."""
    return -F.log(F.least(F.greatest(probability, F.lit(EPSILON)), F.lit(1.0 - EPSILON)))


def log_loss(scored: DataFrame, probability: Column) -> DataFrame:
    """One row: mean log loss and perplexity. `probability` is that of the true class."""
    return scored.agg(F.avg(clipped_loss(probability)).alias("log_loss")).withColumn(
        "perplexity", F.exp("log_loss")
    )


def probability_of(probabilities: str = "probabilities", label: str = "label_id") -> Column:
    """Probability of the true class from an array indexed by class number."""
    return F.coalesce(F.get(F.col(probabilities), F.col(label).cast("int")), F.lit(0.0))


def share_of(share: str = "share", label: str = "label_id") -> Column:
    """Vote share of the true class."""
    own = F.filter(F.col(share), lambda s: s["label_id"] == F.col(label))
    return F.coalesce(F.get(own, 0)["share"], F.lit(0.0))


def majority_class(train: DataFrame, label: str = "label_id") -> DataFrame:
    """One row `pred`: the most frequent class, ties to the smallest."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias("pred"))


def majority_baseline(train: DataFrame, validation: DataFrame, label: str = "label_id") -> DataFrame:
    """Metrics of always predicting the majority class."""
    return weighted_metrics(validation.withColumn("pred", majority_class(train, label).scalar()), label)


def pair_predictions(pairs: DataFrame, similarity: str = "similarity", threshold: float = 0.5) -> DataFrame:
    """Predict 1 for pairs at or above the threshold."""
    return pairs.withColumn("pred", F.when(F.col(similarity) >= threshold, 1).otherwise(0))


def pair_classifier(pairs: DataFrame, label: str = "label", threshold: float = 0.5) -> DataFrame:
    scored = pair_predictions(pairs, threshold=threshold)
    return weighted_metrics(scored, label).select("accuracy", "f1")


# --- correlation ---------------------------------------------------------------------------------


def with_average_rank(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Add `out`, the rank of the value within `by`, from 1; equal values share the mean of their places.

    The rows go to ranges of the value's order, where they stay. Equal values may lie in several ranges, as a value can fill a third of the
    rows: only the least and the largest value of a range can go on in another one, so their places are settled in the
    table of ranges, and all others within their range.
    """
    order = [F.col(value), F.xxhash64(*df.columns)]
    placed = stage(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranks")
    here = [*by, "_range"]
    each_value = placed.groupBy(*here, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    table = each_value.groupBy(*here).agg(
        F.sum("_c").alias("_n"), F.min("_v").alias("_low"), F.min_by("_c", "_v").alias("_lows"), F.max("_v").alias("_high"), F.max_by("_c", "_v").alias("_highs")
    )
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    table = table.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # Of each border value of a group: its first place and how often it occurs in all ranges.
    low = F.struct(F.col("_low").alias("v"), F.col("_start").alias("at"), F.col("_lows").alias("n"))
    high = F.struct(F.col("_high").alias("v"), (F.col("_start") + F.col("_n") - F.col("_highs")).alias("at"), F.col("_highs").alias("n"))
    each = F.explode(F.when(F.col("_low") == F.col("_high"), F.array(low)).otherwise(F.array(low, high)))
    borders = table.select(*here, each.alias("b")).select(*here, "b.*")
    whole = W.partitionBy(*by, "v")
    mean = F.min("at").over(whole) + (F.sum("n").over(whole) + 1) / 2
    borders = borders.select(*here, "v", mean.alias("mean")).groupBy(*here).agg(
        F.min_by("mean", "v").alias("_low_rank"), F.max_by("mean", "v").alias("_high_rank")
    )
    ranges = stage(join_null_safe(table, borders, here).select(*here, "_low", "_high", "_start", "_low_rank", "_high_rank"), "ranges")
    local = W.partitionBy(*here)
    rows = placed.withColumns(
        {"_first": F.rank().over(local.orderBy(value)), "_ties": F.count(F.lit(1)).over(W.partitionBy(*here, value))}
    )
    rows = join_null_safe(rows, ranges, here)
    inner = F.col("_start") + F.col("_first") + (F.col("_ties") - 1) / 2
    rank = F.when(F.col(value) == F.col("_low"), F.col("_low_rank")).when(F.col(value) == F.col("_high"), F.col("_high_rank")).otherwise(inner)
    return rows.withColumn(out, rank).select(*df.columns, out)


def pair_correlation(pairs: DataFrame, by: list[str], similarity: str = "similarity", label: str = "label") -> DataFrame:
    """(by…, cosine_pearson, cosine_spearman) of similarity and label; null if either is constant."""
    joined = pairs.select(*by, F.col(similarity).alias("x"), F.col(label).cast("double").alias("y"))
    # Each pair carries its ranks along; null values have none.
    for name in ("x", "y"):
        joined = with_average_rank(joined.where(F.col(name).isNotNull()), name, by, f"rank_{name}")
    varies = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))

    def correlation(a, b):
        return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))

    return joined.groupBy(*by).agg(
        correlation("x", "y").alias("cosine_pearson"), correlation("rank_x", "rank_y").alias("cosine_spearman")
    )
