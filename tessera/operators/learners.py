"""Learners on vectors: a linear probe of how well they part the classes, and a projection to two dimensions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import cut
from tessera.operators import metrics


def _scaled() -> StandardScaler:
    return StandardScaler(inputCol="vector", outputCol="features", withMean=True, withStd=True)


def linear_probe(items: DataFrame, most: int | None = 2000, seed: int = config.SEED) -> DataFrame:
    """One row (n, accuracy, f1_weighted, f1_macro, balanced_accuracy, verdict) for items (key, label, embedding).

    At most so many rows of each label count, or all of them where most is None; all-zero vectors don't. A logistic regression, its classes weighted to
    count alike, is fitted on the train and val splits and judged on test."""
    chosen = items if most is None else metrics.stratified_sample(items, "key", "label", most, seed)
    chosen = chosen.filter(F.exists("embedding", lambda v: v != 0))
    if most is None:
        # Keys, which are unique here, and labels alone are ranked; vectors are dealt once and written, as the fit reads them often.
        split = metrics.stratified_split(chosen.select("key", "label"), "key", "label", 0.70, 0.0, seed).select("key", "split")
        parts = cut(items.sparkSession, chosen.join(split, "key"), "split")
    else:
        parts = metrics.stratified_split(chosen, "key", "label", 0.70, 0.0, seed)
    weights = parts.filter("split <> 'test'").groupBy("label").agg((1 / F.count("*")).alias("weight"))
    rows = parts.join(F.broadcast(weights), "label").select("key", "label", "split", "weight", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))  # a row for each class
    model = Pipeline(stages=[_scaled(), LogisticRegression(labelCol="label", weightCol="weight", maxIter=100)]).fit(rows.filter("split <> 'test'"))
    got = predicted(model, rows.filter("split = 'test'"))
    classes = items.select("label").distinct().count()
    out = metrics.eval_metrics(got)
    return out.withColumn("verdict", metrics.probe_verdict(F.col("balanced_accuracy"), F.lit(classes)))


def pca_projection(items: DataFrame, most: int = 500, seed: int = config.SEED) -> DataFrame:
    """(key, label, x, y) of at most so many rows of each label, standardised; the signs of the axes mean nothing."""
    rows = metrics.stratified_sample(items, "key", "label", most, seed).select("key", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))
    model = Pipeline(stages=[_scaled(), PCA(k=2, inputCol="features", outputCol="plane")]).fit(rows)
    at = vector_to_array("plane")
    return model.transform(rows).select("key", "label", at[0].alias("x"), at[1].alias("y"))


def keep_best(items: DataFrame, path: str, settings: tuple[float, ...] = (0.0, 0.01, 0.1), seed: int = config.SEED) -> tuple[list[dict], DataFrame]:
    """(history, test): a classifier of items (key, label, embedding) for each regularisation, the one of best macro F1 on
    val saved to path and loaded again for the metrics of test. Equal scores keep the earlier one."""
    parts = metrics.stratified_split(items, "key", "label", seed=seed).withColumn("vector", array_to_vector(F.col("embedding").cast("array<double>")))
    history, best = [], -1.0
    for i, strength in enumerate(settings):
        model = Pipeline(stages=[_scaled(), LogisticRegression(labelCol="label", regParam=strength, maxIter=100)]).fit(parts.filter("split = 'train'"))
        score = metrics.eval_metrics(predicted(model, parts.filter("split = 'val'"))).first().f1_macro
        history.append({"epoch": i + 1, "strength": strength, "va_f1m": score, "improved": score > best})
        if score > best:
            best = score
            model.write().overwrite().save(path)
    return history, metrics.eval_metrics(predicted(PipelineModel.load(path), parts.filter("split = 'test'")))


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(F.col("label").cast("long").alias("y_true"), F.col("prediction").cast("long").alias("y_pred"))
