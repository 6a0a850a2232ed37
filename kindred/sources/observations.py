"""Observation tables: scans, export, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.operators import ranks
from kindred.schemas import OBSERVATIONS


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Scan a CSV that carries its ``idx_global``; columns come by position, nothing is inferred.

    An observation written as ``-`` (or any other text) is NULL.
    """
    return spark.read.schema(OBSERVATIONS).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_unnumbered(spark: SparkSession, path: str) -> DataFrame:
    """Scan CSV files without an id: number the rows by file name and place in the file.

    File order only exists while reading. A row's place in its file split comes
    from the scan; the splits are counted (one row per split) and their offsets
    added. Store the result; every later step joins on ``idx_global``.
    """
    schema = T.StructType(OBSERVATIONS.fields[1:])
    split = ["_file", "_start"]
    rows = spark.read.schema(schema).option("header", True).csv(path).select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"))
    sizes = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.col("_before") + F.col("_seq") - F.col("_first")
    return rows.join(offsets, split).select(
        place.alias("idx_global"), *[f.name for f in schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def first_rows(df: DataFrame, n: int, id_col: str = "idx_global") -> DataFrame:
    """The first ``n`` records in file order."""
    return df.orderBy(id_col).limit(n)


def sample_rows(df: DataFrame, fraction: float = 0.01, id_col: str = "idx_global",
                seed: str = "42", exact: bool = True) -> DataFrame:
    """Random rows without replacement: an exact count by seeded hash, or Spark's own sample."""
    if exact:
        return ranks.exact_sample(df, fraction, id_col, seed)
    return df.sample(False, fraction, int(seed))


def add_columns(vectors: DataFrame, observations: DataFrame, columns: list[str],
                id_col: str = "idx_global") -> DataFrame:
    """Source columns next to the vectors of the same row."""
    return observations.select(id_col, *columns).join(vectors, id_col)


def fetch_rows(ids: DataFrame, observations: DataFrame, id_col: str = "idx_global") -> DataFrame:
    """Source rows by id; ids outside the table stay, with ``found`` false."""
    source = observations.withColumn("found", F.lit(True))
    return ids.join(source, id_col, "left").withColumn("found", F.coalesce("found", F.lit(False)))
