"""The given tables in the shapes the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOISE_LABEL = 9


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """idx_global, embedding, label, and ``cl``: the label with one class read as noise."""
    e = load(spark, folder, "embeddings")
    noise = F.when(F.col("label") == NOISE_LABEL, F.lit(-1)).otherwise(F.col("label"))
    return e.select(F.col("vec_id").alias("idx_global"), "embedding",
                    F.col("label").cast("int").alias("label"), noise.cast("int").alias("cl"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as observations: place, year, topic, reference, value."""
    o = load(spark, folder, "orders")
    c = load(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = load(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
        .select(F.col("o_orderkey").alias("idx_global"), F.col("n_name").alias("spatial"),
                F.year("o_orderdate").cast("string").alias("temporal"),
                F.col("o_orderpriority").alias("interest"), F.col("c_mktsegment").alias("reference"),
                F.col("o_totalprice").alias("observation"), F.col("n_regionkey").alias("region"))
    )


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


E_SQL = (
    "e as (select vec_id as id, embedding::double[] as v, label::int as label, "
    f"case when label = {NOISE_LABEL} then -1 else label end::int as cl from embeddings)"
)

OBS_SQL = (
    "obs as (select o_orderkey as idx_global, n_name as spatial, "
    "cast(year(o_orderdate) as varchar) as temporal, o_orderpriority as interest, "
    "c_mktsegment as reference, o_totalprice as observation, n_regionkey as region "
    "from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"
)
