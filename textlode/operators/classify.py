"""Logistic regression on vectors, saved models and parameter search."""

from __future__ import annotations

from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.functions import vectors as V
from textlode.operators import metrics as M
from textlode.operators.clean import union_all
from textlode.operators.knn import knn
from textlode.operators.scale import stage


# Fits of a parameter search that run at once.
AT_ONCE = 4
# Relative change of the loss at which a fit ends.
TOLERANCE = 1e-10


def features(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    known = df.where(F.col(vec_col).isNotNull())
    return known.withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))


def fit_logistic(
    train: DataFrame, vec_col: str = "embedding", label_col: str = "label_id", max_iter: int = 1000, c: float = 1.0
) -> LogisticRegressionModel:
    """Multinomial logistic regression with an L2 penalty of strength 1 / c on the summed loss."""
    rows = features(train, vec_col).select("features", F.col(label_col).cast("double").alias("_label"))
    estimator = LogisticRegression(
        labelCol="_label",
        maxIter=max_iter,
        family="multinomial",
        standardization=False,
        regParam=1.0 / (c * max(train.count(), 1)),
        tol=TOLERANCE,
    )
    return estimator.fit(rows)


def gradient(model: LogisticRegressionModel, train: DataFrame, vec_col: str = "embedding", label_col: str = "label_id") -> DataFrame:
    """(label_id, component, gradient) of the mean penalised loss at the model's coefficients; component -1 is the intercept.

    It is 0 in every place at the optimum. The rows' probabilities are added up per class and component in one aggregate; the
    penalty is the model's regParam.
    """
    scored = predict(model, train, vec_col).where(F.col(label_col).isNotNull())
    ones = F.concat(F.col(vec_col).cast("array<double>"), F.array(F.lit(1.0)))
    gap = F.transform("probabilities", lambda p, j: p - F.when(j == F.col(label_col), 1.0).otherwise(0.0))
    rows = scored.select(ones.alias("x"), F.posexplode(gap).alias("label_id", "gap"))
    cells = rows.select("label_id", "gap", F.posexplode("x").alias("component", "value"))
    sums = cells.groupBy("label_id", "component").agg(F.avg(F.col("gap") * F.col("value")).alias("mean"))
    weights = model.coefficientMatrix.toArray()
    table = [(j, d, float(w)) for j, row in enumerate(weights) for d, w in enumerate(row)]
    table += [(j, weights.shape[1], 0.0) for j in range(weights.shape[0])]
    own = train.sparkSession.createDataFrame(table, "label_id int, component int, weight double")
    found = sums.join(own, ["label_id", "component"])
    component = F.when(F.col("component") == weights.shape[1], -1).otherwise(F.col("component"))
    return found.select(
        "label_id", component.alias("component"), (F.col("mean") + model.getRegParam() * F.col("weight")).alias("gradient")
    )


def has_learnt(model: LogisticRegressionModel, train: DataFrame, vec_col: str = "embedding", label_col: str = "label_id") -> DataFrame:
    """One row (learnt): whether the model's mean loss on the rows is below the entropy of their classes, which is what intercepts alone reach."""
    scored = predict(model, train, vec_col).where(F.col(label_col).isNotNull())
    per_class = scored.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"), F.sum(M.clipped_loss(M.probability_of("probabilities", label_col))).alias("loss"))
    sums = per_class.agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum(F.col("n") * F.log("n")).alias("x"))
    entropy = F.log("n") - F.col("x") / F.col("n")
    return sums.select((F.col("loss") / F.col("n") < 0.999 * entropy).alias("learnt"))


def predict(model: LogisticRegressionModel, df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Add pred and probabilities, an array indexed by class number."""
    scored = model.transform(features(df, vec_col))
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability").alias("probabilities"),
    )


def predict_class(model: LogisticRegressionModel, df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return predict(model, df, vec_col).drop("probabilities")


def predict_probabilities(model: LogisticRegressionModel, df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return predict(model, df, vec_col).drop("pred")


def argmax_class(df: DataFrame, scores: str = "probabilities") -> DataFrame:
    """Add pred, the position of the largest score."""
    return df.withColumn("pred", V.argmax(scores))


def save_model(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def score(model: LogisticRegressionModel, test: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row: accuracy, macro precision, recall and f1, log loss and perplexity of a model on test rows."""
    scored = predict(model, test, vec_col)
    # One pass: the confusion aggregate carries the summed loss along.
    cells = scored.groupBy(F.col("label_id").alias("label"), "pred").agg(
        F.count(F.lit(1)).alias("n"), F.sum(M.clipped_loss(M.probability_of())).alias("loss")
    )
    return (
        M.class_scores(cells, carry=["loss"])
        .agg(
            M.ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
            *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")],
            M.ratio(F.sum("loss"), F.sum("support")).alias("log_loss"),
        )
        .withColumn("perplexity", F.exp("log_loss"))
    )


def search_logistic(
    train: DataFrame, validation: DataFrame, grid: dict[str, list], vec_col: str = "embedding"
) -> DataFrame:
    """One row per combination of the grid (c, max_iter) with its weighted f1 on the validation rows, best first."""
    # Written once: every fit reads them several times.
    train, validation = (stage(df.select(vec_col, "label_id"), "grid") for df in (train, validation))
    def fitted(combination):
        run, values = combination
        params = dict(zip(grid, values))
        model = fit_logistic(train, vec_col, **params)
        f1 = M.weighted_metrics(predict(model, validation, vec_col)).select("f1")
        columns = [F.lit(v).alias(k) for k, v in params.items()]
        return f1.select(F.lit(run).alias("run_idx"), *columns, "f1")

    # Fits are many short jobs: several at once keep the cluster busy.
    with ThreadPool(AT_ONCE) as pool:
        results = pool.map(inheritable_thread_target(train.sparkSession)(fitted), enumerate(product(*grid.values()), start=1))
    return union_all(results).orderBy(F.desc("f1"), "run_idx")


def search_k(
    train: DataFrame, validation: DataFrame, ks: list[int], id_col: str = "id", vec_col: str = "embedding", label_col: str = "label_id"
) -> DataFrame:
    """(k, f1): weighted f1 on the validation rows for each k, best first. Neighbours are searched once."""
    neighbours = knn(validation, train, max(ks), id_col, vec_col, label_col)
    truth = validation.select(F.col(id_col).alias("query_id"), F.col(label_col).alias("truth"))
    each_k = F.explode(F.array(*[F.lit(k) for k in ks]))
    counts = (
        neighbours.withColumn("k", each_k)
        .where("rank <= k")
        .groupBy("query_id", "k", "label_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("query_id", "k").agg(F.min(F.struct((-F.col("n")).alias("n"), "label_id")).alias("best"))
    scored = best.join(truth, "query_id").select("k", F.col("truth").alias("label_id"), F.col("best.label_id").alias("pred"))
    return M.weighted_metrics(scored, by=["k"]).select("k", "f1").orderBy(F.desc("f1"), "k")
