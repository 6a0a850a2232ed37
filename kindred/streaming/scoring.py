"""Scoring queries as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.sources import logs


def query_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Queries from Parquet files appearing under ``path`` (a folder or a glob)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def score_stream(queries: DataFrame, score: Callable[[DataFrame], DataFrame], out: str,
                 checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply the batch ``score`` function to every micro-batch and append the result to ``out``.

    Each batch writes its own folder ``batch=<id>``, replacing it when the batch is
    run again after a failure, so a replay never doubles rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    writer = queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def log_stream(predictions: DataFrame, out: str, checkpoint: str, query_id: str = "query_id",
               available_now: bool = True) -> StreamingQuery:
    """Append predictions with running ids, in folders by batch.

    Every batch leaves its highest id in a one-row table of its own (under
    ``_last``, which readers of the log pass over), and the next batch reads only
    that one, so the work of a batch does not grow with the log. A batch that is
    run again gets the ids it had and replaces its rows. A log without such a
    table for the batch before (made by other means) is read once.
    """
    root = out.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Batches are numbered one by one, so the one before is known by its number.
        last = logs.read_log(spark, f"{root}/_last/batch={batch_id - 1}", "last_id long")
        if not last.take(1):
            earlier = logs.read_log(spark, root, "id long, batch long").where(F.col("batch") < batch_id)
            last = earlier.agg(F.max("id").alias("last_id"))
        path = f"{root}/batch={batch_id}"
        logs.next_ids(batch, last, query_id).write.mode("overwrite").parquet(path)
        highest = logs.read_log(spark, path, "id long").agg(F.max("id").alias("_own"))
        highest.join(last).select(F.coalesce("_own", "last_id", F.lit(0)).cast("long").alias("last_id")).coalesce(
            1).write.mode("overwrite").parquet(f"{root}/_last/batch={batch_id}")

    writer = predictions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
