"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def build_session(app: str = "kindred", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle width is left to the cluster (AQE merges small partitions); pass
    ``spark.sql.shuffle.partitions`` through ``conf`` to set it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites on every column expression cost more than the planning itself.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application (as ``--py-files`` would)."""
    context = spark.sparkContext
    if not any(f.endswith("kindred_package.zip") for f in context.listFiles):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="kindred-"), "kindred_package")
        context.addPyFile(shutil.make_archive(base, "zip", root, "kindred"))
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one machine, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can read")
    folder = tempfile.mkdtemp(prefix="kindred-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/kindred/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", folders: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative jobs use this between rounds: the plan stops growing, a lost
    executor rereads files instead of recomputing, and the reread table has real
    size statistics, so joins pick broadcast by size. ``folders`` are columns to
    split the table by; a filter on them then has its own true size.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*folders) if folders else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def cut_counting(df: DataFrame, name: str = "cut", condition: str | None = None) -> tuple[DataFrame, int]:
    """``cut``, and how many of the written rows meet ``condition`` (all rows: read off the footers)."""
    out = cut(df, name)
    return out, (out.where(condition) if condition else out).count()


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of parameters held by the plan itself (no Python job to read it)."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)
