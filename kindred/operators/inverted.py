"""Approximate nearest neighbours: inverted lists over trained centroids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import neighbours, tiles
from kindred.session import cut

#: The driver and every task hold MAX_CENTROIDS vectors at most; they are trained on SAMPLE rows each.
MAX_CENTROIDS = 1 << 14
SAMPLE, SAMPLE_TASKS = 32, 8
ROUNDS = 6
PROBES = 8
_STRIP = 1024


def _matrix(vectors: pd.Series | list, metric: str) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    return neighbours._unit(x) if metric == "cosine" else x


def _nearest(x: np.ndarray, centroids: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centroids of every row, some rows at a time."""
    out = np.empty((len(x), count), np.int32)
    for at in range(0, len(x), _STRIP):
        d = tiles.euclidean_block(x[at:at + _STRIP], centroids)
        out[at:at + _STRIP] = np.argpartition(d, count - 1, axis=1)[:, :count] if count < len(centroids) else np.arange(count)
    return out


def train_centroids(rows: DataFrame, vec_col: str, count: int, metric: str, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of about ``count`` cells: k-means over ``SAMPLE * count`` rows chosen by hash of their ``id``.

    Every round assigns the sample in ``SAMPLE_TASKS`` tasks, each of which sends one sum a
    cell. A cell that loses all its rows keeps its centroid. For cosine, vectors
    and centroids have length 1.
    """
    # The first of the hashes, written: a top-n of bounded size.
    sample = cut(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * count).select(vec_col).repartition(SAMPLE_TASKS), "centroid-sample")
    centroids = _matrix([r[0] for r in sample.limit(count).collect()], metric)

    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(centroids), np.zeros(len(centroids))
            for batch in batches:
                x = _matrix(batch.column(0).to_pandas(), metric)
                cell = _nearest(x, centroids, 1)[:, 0]
                np.add.at(total, cell, x)
                n += np.bincount(cell, minlength=len(n))
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array(n[held]), pa.array(list(total[held]), pa.list_(pa.float64()))], ["cell", "n", "total"])

        total, n = np.zeros_like(centroids), np.zeros(len(centroids))
        for r in sample.mapInArrow(sums, "cell int, n double, total array<double>").collect():
            total[r["cell"]] += r["total"]
            n[r["cell"]] += r["n"]
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
        if metric == "cosine":
            centroids = neighbours._unit(centroids)
    return centroids


def _listed(df: DataFrame, vec_col: str, centroids: np.ndarray, metric: str) -> DataFrame:
    """``df`` with the nearest ``cell`` of a row."""
    @F.pandas_udf("int")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(_nearest(_matrix(vectors, metric), centroids, 1)[:, 0])

    return df.withColumn("cell", cells(vec_col))


def _wanting(q_tiles: DataFrame, centroids: np.ndarray, probes: int, metric: str) -> DataFrame:
    """Query tiles with the lists any of their rows reads."""
    @F.pandas_udf("array<int>")
    def lists(packed: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_probed(v.reshape(-1, centroids.shape[1]), centroids, probes, metric)) for v in packed])

    return q_tiles.withColumn("wanted", lists("q_vec"))


def _probed(x: np.ndarray, centroids: np.ndarray, probes: int, metric: str) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return _nearest(neighbours._unit(x) if metric == "cosine" else x, centroids, probes)


def suggested_cells(rows: int) -> int:
    """About as many cells as a cell has rows."""
    return max(1, min(MAX_CENTROIDS, round(math.sqrt(rows))))


def probing(probes: int = PROBES, cells: int | None = None, rounds: int = ROUNDS) -> Callable[..., DataFrame]:
    """Search strategy of ``neighbours.knn_join``: every vector is listed under its nearest centroid, a query reads the ``probes`` lists nearest to it.

    Distances of what is found are exact, so are the ranks among it; a neighbour in a
    list that is not read is missed, and a query whose lists hold fewer than k
    rows gets fewer. With ``probes`` equal to ``cells`` the result is exact. Work is
    rows * (cells + probes * rows / cells) products; a list of any length is cut
    into tiles, so a hot cell is spread over as many tasks as it has tiles.
    """
    def pairs(asked: DataFrame, stored: DataFrame, group: list[str], need: int, metric: str, tile_rows: int) -> DataFrame:
        if group:
            raise ValueError("inverted lists search the whole corpus; use pivots or the grid inside groups")
        count = min(cells or suggested_cells(stored.count()), MAX_CENTROIDS)
        centroids = train_centroids(stored, "c_vec", count, metric, rounds) if count > 1 else np.zeros((1, 1))
        reads = min(probes, count)
        # A tile holds rows of one cell, so it asks for few lists; rows are copied neither for their probes nor for tiles.
        q, c = (cut(_listed(df, vec, centroids, metric) if len(centroids) > 1 else df.withColumn("cell", F.lit(0)), name)
                for df, vec, name in ((asked, "q_vec", "probes"), (stored, "c_vec", "lists")))
        keys = ["cell"]
        q_tiles = neighbours._tile(q, neighbours._slot_counts(q, keys, tile_rows, 0), keys, "q_vec", "q_")
        c_tiles = cut(neighbours._tile(c, neighbours._slot_counts(c, keys, tile_rows, 0), keys, "c_vec", "c_").withColumnRenamed("cell", "c_cell"), "list-tiles")
        if reads >= len(centroids):
            return neighbours._search_tiles(cut(q_tiles, "probe-tiles"), c_tiles, need, metric)
        q_tiles = cut(_wanting(q_tiles, centroids, reads, metric), "probe-tiles")
        return neighbours._search_tiles(q_tiles, c_tiles, need, metric, rows_of=lambda x: _probed(x, centroids, reads, metric))

    return pairs


def recall(found: DataFrame, exact: DataFrame, id_col: str = "idx_global") -> DataFrame:
    """``rank, n, found, recall``: how many of the exact neighbours of each rank a search has found."""
    hit = found.select(id_col, "neighbour", F.lit(1).alias("_hit"))
    return exact.join(hit, [id_col, "neighbour"], "left").groupBy("rank").agg(
        F.count("*").alias("n"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.col("n"))
