"""Pruned nearest-neighbour search inside groups: pivots, cells and bounds of every group as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.vectors import euclidean, norm
from kindred.operators import neighbours, ranks, tiles
from kindred.session import cut

# A group has about this many pivots at most, so about MOST ** 2 pairs of cells.
MOST = 256
_DRAW = 1 << 30


def pivots_of(stored: DataFrame, metric: str, tile_rows: int, most: int = MOST) -> DataFrame:
    """``g, pivots``: vectors of each group drawn by hash, one for a group of under four tiles.

    About sqrt(n) of n vectors, where finding a row's cell costs what searching it
    does, ``most`` at most. Every row decides for itself
    from its hash and the size of its group, so no group is ranked or gathered; the
    vector of least hash is a pivot always. They steer pruning only. Unit length for cosine.
    """
    hashed = stored.select("g", F.col("c_vec").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(_DRAW)).alias("h"))
    usable = hashed.where(F.exists("v", lambda x: x != 0)) if metric == "cosine" else hashed
    sizes = cut(usable.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min_by("v", F.struct("h", "v")).alias("first")), "group-sizes")
    want = F.when(F.col("n") < 4 * tile_rows, F.lit(0.0)).otherwise(F.least(F.sqrt("n"), F.lit(float(most))))
    drawn = usable.join(sizes.select("g", "n"), "g").where(F.col("h") * F.col("n") < want * _DRAW).groupBy("g").agg(
        F.collect_list("v").alias("drawn"))
    points = F.sort_array(F.array_distinct(F.concat(F.array("first"), F.coalesce("drawn", F.array().cast("array<array<double>>")))))
    if metric == "cosine":
        points = F.transform(points, lambda p: F.transform(p, lambda x: x / norm(p)))
    return sizes.join(drawn, "g", "left").select("g", points.alias("pivots"))


def _assigned(df: DataFrame, pivots: DataFrame, vec_col: str, metric: str, tile_rows: int) -> DataFrame:
    """``g, id, vec, cell, reach``: the nearest pivot of its group for every row; pivots are sent once per tile."""
    packed = neighbours._tile(df, neighbours._slot_counts(df, ["g"], tile_rows, 0), ["g"], vec_col, "t_").join(pivots, "g", "left")

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = tiles.list_values(batch, "t_id", row)
                x = tiles.matrix(batch, "t_vec", row, len(ids))
                found = batch.column("pivots")[row].as_py()
                cell, reach = np.zeros(len(x), np.int32), np.zeros(len(x))
                unit = neighbours._unit(x) if metric == "cosine" else x
                if found:  # none: the group has no vector with a direction
                    d = tiles.euclidean_block(unit, np.array(found))
                    cell = d.argmin(axis=1).astype(np.int32)
                    reach = d[np.arange(len(d)), cell]
                if metric == "cosine":
                    # Vectors without a direction: similarity 0 to all, a cell of their own without pivot.
                    blank = ~unit.any(axis=1)
                    cell[blank], reach[blank] = -1, 0.0
                values = batch.column("t_vec")[row].values
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * x.shape[1], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("g").take(pa.array(np.full(len(ids), row))), pa.array(ids), lists, pa.array(cell), pa.array(reach)],
                    ["g", "id", vec_col, "cell", "reach"])

    schema = T.StructType([df.schema["g"], df.schema["id"], T.StructField(vec_col, df.schema[vec_col].dataType),
                           T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())])
    return packed.select("g", "t_id", "t_vec", "pivots").mapInArrow(work, schema)


def pivot_pairs(asked: DataFrame, stored: DataFrame, group: list[str], need: int, metric: str, tile_rows: int) -> DataFrame:
    """Search strategy of ``neighbours.knn_join`` with ``by``: exact, skips cells too far to hold anything nearer.

    Every cell of queries is first searched in the same cell of its group. The worst
    ``need``-th distance found there bounds it, as does any cell of ``need`` vectors by the
    sum of its distance and both reaches: by the triangle inequality another cell
    matters only if its pivot is no farther than both reaches and the lesser bound.
    Pivots, reaches and bounds are joined by group; nothing of them comes to the
    driver. A small group is one cell, which is the full search.
    """
    if not group:
        raise ValueError("the search by group cells needs groups; without them use pivots")
    g_type, keys = asked.schema["g"].dataType, ["g", "cell"]
    pivots = cut(pivots_of(stored, metric, tile_rows), "group-pivots")
    q = cut(_assigned(asked, pivots, "q_vec", metric, tile_rows), "group-query-cells")
    c = cut(_assigned(stored, pivots, "c_vec", metric, tile_rows), "group-corpus-cells")
    c_slots = neighbours._slot_counts(c, keys, tile_rows, 0)
    q_tiles = cut(neighbours._tile(q.drop("reach"), neighbours._slot_counts(q, keys, tile_rows, 0), keys, "q_vec", "q_"), "group-q-tiles")
    c_tiles = cut(neighbours._tile(c.drop("reach"), c_slots, keys, "c_vec", "c_"), "group-c-tiles")
    first = cut(neighbours._run_pairs(q_tiles, c_tiles, c_slots, keys, keys, need, metric, g_type), "group-own")

    kth = ranks.top_n(first, ["g", "q_rep"], [F.col("dist"), F.col("c_rep")], need, "_r").groupBy("g", F.col("q_rep").alias("id")).agg(
        F.max("dist").alias("kth"), F.count(F.lit(1)).alias("found"))
    length = F.sqrt(F.lit(2.0) * F.greatest(F.col("kth"), F.lit(0.0))) if metric == "cosine" else F.col("kth")
    bound = F.max(F.when(F.col("found") >= need, length).otherwise(F.lit(float("inf")))).alias("bound")
    at = pivots.select("g", F.posexplode("pivots").alias("cell", "point"))
    q_cells = q.select(*keys, "id", "reach").join(kth, ["g", "id"], "left").groupBy(*keys).agg(
        bound, F.max("reach").alias("reach")).join(at, keys, "left")
    c_cells = c.groupBy(*keys).agg(F.max("reach").alias("c_reach"), F.count(F.lit(1)).alias("n")).join(c_slots, keys).join(
        at, keys, "left").select("g", F.col("cell").alias("c_cell"), "c_reach", "n", "slots", F.col("point").alias("c_point"))
    # At most (MOST + 1) ** 2 rows a group. Without a pivot on one side: right angles.
    both = q_cells.join(c_cells, "g").withColumn("apart", F.coalesce(euclidean("point", "c_point"), F.lit(2.0) ** 0.5))
    reaches = F.col("reach") + F.col("c_reach")
    limit = F.least("bound", F.min(F.when(F.col("n") >= need, F.col("apart") + reaches)).over(Window.partitionBy(*keys)))
    partners = cut(both.withColumn("limit", limit).where(
        (F.col("cell") != F.col("c_cell")) & (F.col("apart") - reaches <= F.col("limit") + F.lit(1e-9))).select(
        "g", "cell", "c_cell", "slots"), "group-partners")
    rest = neighbours._run_pairs(q_tiles, c_tiles.withColumnRenamed("cell", "c_cell"), partners, keys, ["g", "c_cell"], need, metric, g_type)
    return first.unionByName(rest)
