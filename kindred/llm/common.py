"""Small helpers the training-text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.session import ship_package

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{folder}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """Hash that tells the texts of one doc_id apart (null and empty alike)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a function that turns one batch into one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def best_rows(df: DataFrame, by: list[str], order: list[Column], n: int, spread: Column, salts: int = 32) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``; rows of a hot group meet in ``salts`` parts first, dealt by ``spread``."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    for keys in ([*by, "_salt"], by):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    return salted.drop("_salt")
