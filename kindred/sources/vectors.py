"""Embedding tables: array form for work, wide form for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.vectors import element_columns


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_wide(df: DataFrame, dim: int, keep: list[str] = (), vec_col: str = "embedding") -> DataFrame:
    """``keep``, then one column per coordinate (0 .. dim-1), then ``label`` where present."""
    tail = ["label"] if "label" in df.columns and "label" not in keep else []
    return df.select(*keep, *element_columns(vec_col, dim), *tail)


def from_wide(df: DataFrame, keep: list[str] = (), require_label: bool = True) -> DataFrame:
    """Wide columns back to one array; without a ``label`` column this is an error."""
    if require_label and "label" not in df.columns:
        raise ValueError("no label column in the labelled embeddings")
    dims = sorted((c for c in df.columns if c.isdigit()), key=int)
    vector = F.array(*[F.col(f"`{c}`") for c in dims]).cast("array<float>").alias("embedding")
    label = [F.col("label").cast("int").alias("label")] if "label" in df.columns else []
    return df.select(*keep, vector, *label)


def read_wide_csv(spark: SparkSession, path: str, dim: int, keep: list[str] = (),
                  labelled: bool = True) -> DataFrame:
    """Scan a wide CSV with an explicit schema. ``keep`` columns are long ids at the front."""
    header = spark.read.option("header", True).csv(path).columns
    if labelled and "label" not in header:
        raise ValueError(f"no label column in {path}")
    fields = [T.StructField(c, T.LongType()) for c in keep]
    fields += [T.StructField(str(i), T.DoubleType()) for i in range(dim)]
    if labelled:
        fields.append(T.StructField("label", T.IntegerType()))
    return from_wide(spark.read.schema(T.StructType(fields)).option("header", True).csv(path), keep, labelled)


def write_vectors(df: DataFrame, path: str, model: str, mode: str = "append") -> None:
    """One folder per embedding model."""
    df.withColumn("model", F.lit(model)).write.mode(mode).partitionBy("model").parquet(path)


def write_labelled(df: DataFrame, path: str, files_per_label: int = 1, mode: str = "overwrite",
                   id_col: str = "idx_global") -> None:
    """Labelled vectors in folders by label, so a group filter reads only its folder.

    Rows are spread by (label, id hash): a large label becomes several files
    instead of one task's work.
    """
    spread = F.pmod(F.xxhash64(id_col), F.lit(files_per_label))
    df.repartition("label", spread).write.mode(mode).partitionBy("label").parquet(path)


def align_labels(vectors: DataFrame, labels: DataFrame, id_col: str = "idx_global") -> DataFrame:
    """Vectors with the labels of a separate table."""
    return vectors.join(labels.select(id_col, "label"), id_col)


def group_rows(df: DataFrame, label: int) -> DataFrame:
    return df.where(F.col("label") == label)
