"""Registry table of trained classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.naming import adjusted_suffix, method_folder, model_key
from kindred.schemas import REGISTRY
from kindred.session import small_table

_ROW = ("modelo_name string, classifier_type string, use_adjusted boolean, params string, "
        "originales_path string, embeddings_path string, model_path string")


def register(spark: SparkSession, path: str, *, model: str, classifier: str, use_adjusted: bool,
             params: str, observations_path: str, embeddings_path: str, model_path: str) -> DataFrame:
    """Append one classifier under its key ``model_classifier[_adjusted]``; the latest row of a key holds."""
    row = small_table(spark, [(model, classifier, use_adjusted, params, observations_path,
                               embeddings_path, model_path)], _ROW)
    keyed = row.select(
        model_key(F.col("modelo_name"), F.col("classifier_type"), F.col("use_adjusted")).alias("model_key"),
        "modelo_name", "classifier_type", "use_adjusted", method_folder(F.col("params")).alias("params"),
        "originales_path", "embeddings_path", "model_path", F.current_timestamp().alias("registered_at"))
    keyed.select(*[F.col(f.name).cast(f.dataType) for f in REGISTRY]).write.mode("append").parquet(path)
    return keyed


def latest(registry: DataFrame, key: str = "model_key") -> DataFrame:
    """One row per key: the one registered last (without times: an equal row; ties by the row's values)."""
    others = [c for c in registry.columns if c not in (key, "registered_at")]
    time = [F.col("registered_at")] if "registered_at" in registry.columns else []
    best = registry.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*time, *others)).alias("_row"))
    return best.select(key, "_row.*")


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """What is registered, without the models themselves; a key registered again is listed once."""
    return latest(spark.read.schema(REGISTRY).parquet(path)).drop("model_path").withColumn(
        "suffix", adjusted_suffix(F.col("use_adjusted")))


def lookup(queries: DataFrame, registry: DataFrame, key: str = "model_key") -> DataFrame:
    """Attach the registry row to each query; a key that is not registered fails the job."""
    rows = latest(registry, key).withColumn("_known", F.lit(True))
    joined = queries.join(rows, key, "left")
    message = F.concat(F.lit("classifier not loaded: "), F.coalesce(F.col(key), F.lit("(none)")))
    check = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return joined.where(check).drop("_known")
