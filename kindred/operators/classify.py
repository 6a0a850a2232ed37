"""Classifiers on cluster labels, as Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Mapping
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import kernel, metrics, split
from kindred.operators.quality import spread
from kindred.session import cut_counting, small_table

# Classifier settings.
SEED = 42
TREES = 100
PERCEPTRON_HIDDEN = 100
PERCEPTRON_ROUNDS = 100
CV_FOLDS = 3
# Rows of a part of the training table.
LEAST_ROWS, PART_ROWS = 1 << 10, 1 << 18
KINDS = ("random_forest", "svm", "mlp")


def with_features(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))


def classifiers(dim: int, classes: int) -> dict[str, Estimator]:
    """The estimators trained beside the kernel machine, each ending in ``prediction`` and ``probability``."""
    target = {"labelCol": "label_index"}
    return {
        "random_forest": RandomForestClassifier(numTrees=TREES, seed=SEED, **target),
        "mlp": MultilayerPerceptronClassifier(
            layers=[dim, PERCEPTRON_HIDDEN, classes], maxIter=PERCEPTRON_ROUNDS, seed=SEED, **target),
    }


def _prepare(df: DataFrame, label: str, vec_col: str):
    """Index the labels once (noise is a class of its own) and read the sizes the estimators need."""
    named = with_features(df, vec_col).withColumn("label_text", F.col(label).cast("string"))
    indexer = StringIndexer(inputCol="label_text", outputCol="label_index",
                            stringOrderType="alphabetAsc").fit(named)
    dim = df.select(F.size(vec_col)).first()[0]
    variance = -spread(df, vec_col).first()[0]
    gamma = 1.0 / (dim * variance) if variance > 0 else 1.0
    return named, indexer, dim, gamma


def _training_rows(indexed: DataFrame) -> DataFrame:
    """``indexed`` held for the rounds of the fits, in as many parts as there are cores (more beyond PART_ROWS each).

    A persisted shuffle keeps all its partitions, however small, and every task of a forest
    sends the statistics of all nodes of a level, so more parts than cores are pure cost.
    """
    rows, n = cut_counting(indexed, "training-rows")
    cores = indexed.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(cores, n // LEAST_ROWS), -(-n // PART_ROWS))).persist()


def _named_model(indexer: Model, fitted: Model) -> PipelineModel:
    back = IndexToString(inputCol="prediction", outputCol="predicted_text", labels=indexer.labels)
    return PipelineModel(stages=[fitted, back])


def train(df: DataFrame, kinds: list[str] | None = None, label: str = "label",
          vec_col: str = "embedding") -> dict[str, PipelineModel]:
    """Fit the chosen classifiers (all by default) on the labelled vectors."""
    split.require_classes(df, label)
    named, indexer, dim, gamma = _prepare(df, label, vec_col)
    # The kernel machine sets its probabilities on rows outside its training folds; copies share a fold.
    indexed = _training_rows(indexer.transform(named).select("features", "label_index", F.pmod(
        F.xxhash64(vec_col), F.lit(CV_FOLDS)).alias("fold")))
    try:
        classes = len(indexer.labels)
        made = classifiers(dim, classes)
        return {k: _named_model(indexer, kernel.fit(indexed, CV_FOLDS, classes, dim, gamma, SEED)[0]
                                if k == "svm" else made[k].fit(indexed)) for k in kinds or KINDS}
    finally:
        indexed.unpersist()


def _fold_scores(estimator: Estimator, indexed: DataFrame, folds: int) -> list[float]:
    """Accuracy on each fold of a model of the others; the folds are trained side by side."""
    judge = MulticlassClassificationEvaluator(labelCol="label_index", metricName="accuracy")
    fold = F.col("fold")

    @inheritable_thread_target(indexed.sparkSession)
    def score(i: int) -> float:
        return judge.evaluate(estimator.fit(indexed.where(fold != i)).transform(indexed.where(fold == i)))

    with ThreadPool(folds) as pool:
        return pool.map(score, range(folds))


def cross_validate(df: DataFrame, kinds: list[str] | None = None, folds: int = CV_FOLDS,
                   label: str = "label", id_col: str = "idx_global", vec_col: str = "embedding"
                   ) -> tuple[DataFrame, str, PipelineModel]:
    """k-fold accuracy of each classifier; returns (scores, best name, best model on all rows).

    ``scores``: ``classifier, r1, accuracy, cv_mean, cv_std, cv_scores``, where ``r1``
    (macro recall) and ``accuracy`` are those of the model of all rows on these rows.
    The highest mean wins, ties go to the kind named first.
    """
    split.require_classes(df, label)
    named, indexer, dim, gamma = _prepare(df, label, vec_col)
    indexed = _training_rows(split.kfold(indexer.transform(named), folds, id_col).select(
        "features", "label_index", "fold"))
    try:
        classes = len(indexer.labels)
        made = classifiers(dim, classes)
        rows, models = [], {}
        for kind in kinds or KINDS:
            if kind == "svm":
                fitted, by_fold = kernel.fit(indexed, folds, classes, dim, gamma, SEED)
            else:
                by_fold = _fold_scores(made[kind], indexed, folds)
                fitted = made[kind].fit(indexed)
            # One row per pair of classes.
            counts = metrics.confusion(fitted.transform(indexed), truth="label_index", predicted="prediction").persist()
            known = (metrics.macro_recall(counts).first()["r1"], metrics.accuracy(counts).first()["accuracy"])
            counts.unpersist()
            rows.append((kind, *known, float(np.mean(by_fold)), float(np.std(by_fold)), by_fold))
            models[kind] = _named_model(indexer, fitted)
    finally:
        indexed.unpersist()
    best = max(rows, key=lambda r: r[3])[0]
    scores = small_table(df.sparkSession, rows, "classifier string, r1 double, accuracy double, cv_mean double, "
                                                "cv_std double, cv_scores array<double>")
    return scores, best, models[best]


def save_results(scores: DataFrame, best: str, folder: str, model: str, suffix: str = "") -> None:
    """Append the scores of an embedding model's classifiers, and write which one is best with its score and seed."""
    folder = folder.rstrip("/")
    scores.withColumnsRenamed({"classifier": "classifier_model"}).select(
        F.lit(model).alias("embeding_model"), "*").write.mode("append").parquet(f"{folder}/train_results")
    scores.where(F.col("classifier") == best).select(
        F.col("classifier").alias("best_model"), F.col("cv_mean").alias("best_score"), F.lit(SEED).alias("random_state")
    ).write.mode("overwrite").parquet(f"{folder}/classification_info{suffix}")


def predict(model: PipelineModel, df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Add ``predicted``, ``confidence`` and ``probabilities`` (highest first) to the rows."""
    labels = model.stages[-1].getLabels()
    scored = model.transform(with_features(df, vec_col))
    probability = vector_to_array("probability")
    names = F.array(*[F.lit(int(v)) for v in labels])
    listed = F.transform(
        F.arrays_zip(names.alias("label"), probability.alias("probability")),
        lambda s: F.struct((-s["probability"]).alias("o"), s["label"].alias("label")))
    ordered = F.transform(F.sort_array(listed), lambda s: F.struct(
        s["label"].alias("label"), (-s["o"]).alias("probability")))
    return scored.select(
        *df.columns, F.col("predicted_text").cast("int").alias("predicted"),
        F.array_max(probability).alias("confidence"), ordered.alias("probabilities"))


def evaluate(model: PipelineModel, df: DataFrame, label: str = "label", vec_col: str = "embedding"):
    """(accuracy, class report) of a model on labelled rows."""
    counts = metrics.confusion(predict(model, df, vec_col), truth=label)
    return metrics.accuracy(counts), metrics.class_report(counts)


def save_models(models: Mapping[str, PipelineModel], folder: str, suffix: str = "") -> dict[str, str]:
    paths = {}
    for name, model in models.items():
        paths[name] = f"{folder.rstrip('/')}/classifier_{name}{suffix}"
        model.write().overwrite().save(paths[name])
    return paths


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def nearest_centroid(df: DataFrame, label: str = "label", id_col: str = "idx_global",
                     vec_col: str = "embedding") -> DataFrame:
    """Nearest mean vector by cosine: a classifier that is one aggregate and one join.

    The centroid table has one row per class. It is joined as tiles, so it is not
    broadcast on trust. Returns ``id_col, label, predicted, similarity``.
    """
    from kindred.operators.neighbours import knn_join
    centroids = centroid_table(df, label, vec_col)
    hits = knn_join(df.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("embedding")),
                    centroids.withColumnRenamed("label", "c_label"), 1, "cosine",
                    id_col="c_label", vec_col="centroid")
    return df.select(id_col, label).join(
        hits.select(F.col("query_id").alias(id_col), F.col("c_label").cast("int").alias("predicted"),
                    (F.lit(1.0) - F.col("dist")).alias("similarity")), id_col)


def centroid_table(df: DataFrame, label: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label: one grouped sum per coordinate, combined before the shuffle."""
    dim = df.select(F.size(vec_col)).first()[0]
    means = df.groupBy(F.col(label).cast("long").alias("label")).agg(
        *[F.avg(F.col(vec_col)[i].cast("double")).alias(f"_m{i}") for i in range(dim)])
    return means.select("label", F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias("centroid"))
