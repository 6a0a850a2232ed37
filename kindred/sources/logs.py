"""Append-only result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.schemas import EMBEDDING_TIMINGS, HIT_COLUMNS, OBSERVATION_COLUMNS, PREDICTION_LOG


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _moment() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def append_timing(spark: SparkSession, path: str, method: str, seconds: float) -> None:
    row = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.lit(method).alias("metodo"), F.round(F.lit(float(seconds)), 2).alias("tiempo_segundos"))
    append(row, path)


def append_embedding_timings(spark: SparkSession, path: str, model: str, seconds: Mapping[str, float]) -> None:
    """One row of the five stages of an embedding run; a stage that is not given is NULL."""
    row = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit(model).alias("modelo"),
        *[F.round(F.lit(seconds.get(stage)).cast("double"), 2).alias(name) for stage, name in EMBEDDING_TIMINGS.items()])
    append(row, path)


def next_ids(batch: DataFrame, last_id: DataFrame, order: str, out: str = "id",
             chunk_rows: int | None = None) -> DataFrame:
    """Number a batch upwards from the last id of a log (1 when the log is empty).

    ``last_id`` is one row with column ``last_id``. Positions come from ranked
    pieces of the batch, so a large batch is not sorted in one task.
    """
    from kindred.operators import ranks
    width = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    numbered = ranks.relative_index(batch.withColumn("_all", F.lit(0)), ["_all"], order, "_pos", **width)
    start = last_id.select(F.coalesce("last_id", F.lit(0)).alias("_last"), F.lit(0).alias("_all"))
    # One row: the highest id so far.
    return numbered.join(F.broadcast(start), "_all").withColumn(
        out, F.col("_last") + F.col("_pos") + 1).drop("_all", "_pos", "_last")


def read_log(spark: SparkSession, path: str, schema=PREDICTION_LOG) -> DataFrame:
    """The log, or an empty one when nothing was written yet."""
    try:
        log = spark.read.schema(schema).parquet(path)
        log.schema  # a client without a JVM looks at the path only now
        return log
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_predictions(predictions: DataFrame, path: str, query_id: str = "query_id") -> DataFrame:
    """Append predictions (``sentence, predicted, confidence, found``) with running ids."""
    log = read_log(predictions.sparkSession, path)
    rows = next_ids(predictions, log.agg(F.max("id").alias("last_id")), query_id).select(
        _moment().alias("timestamp"), F.col("sentence").alias("query_original"), F.col("predicted").alias("grupo_predicho"),
        F.col("confidence").alias("confianza"), F.col("found").alias("prediccion"), "id")
    append(rows, path)
    return rows


def embedding_log_rows(predictions: DataFrame, cells: Sequence[str] = ()) -> DataFrame:
    """Rows of the embedding log; ``vector_input`` is the JSON list of the input ``cells`` (a NULL cell: null)."""
    typed = F.to_json(F.array(*[F.col(c).cast("string") for c in cells]), {"ignoreNullFields": "false"})
    return predictions.select(
        (typed if cells else F.lit(None).cast("string")).alias("vector_input"),
        F.col("sentence").alias("query_string"), "embedding",
        F.col("predicted").alias("predicted_label"), _moment().alias("timestamp"))


def append_embeddings(predictions: DataFrame, path: str, cells: Sequence[str] = ()) -> None:
    append(embedding_log_rows(predictions, cells), path)


def hit_rows(hits: DataFrame) -> DataFrame:
    """Hydrated hits under the names of the hits table, all queries in one table keyed by ``query_id``."""
    return hits.select(
        "query_id", "rank", *[F.col(c).alias(name) for c, name in HIT_COLUMNS.items()],
        *OBSERVATION_COLUMNS, F.col("sentence_shown").alias("sentencia_procesada"), _moment().alias("timestamp"))


def append_hits(hits: DataFrame, path: str) -> None:
    append(hit_rows(hits), path)


def log_union(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def export_vector_text(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Vectors as JSON text, for exports that cannot hold arrays."""
    return df.withColumn(vec_col, F.to_json(vec_col))


def write_search(path: str, result: DataFrame, trials: DataFrame) -> None:
    """Append a search's trials, and its result row to the table all methods share."""
    append(trials, f"{path.rstrip('/')}/trials")
    append(result, f"{path.rstrip('/')}/results")
