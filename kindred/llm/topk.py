"""Exact top-k inner products by three phases with a uniform threshold over slices of the vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import best_rows, table
from kindred.session import cut

TOP = 5
EVERY = 50
SCALE = 256
SLICES = 2
#: Length of a local list of the first phase: longer lists give a higher cutoff.
FIRST = 32
TILE = 4096
BLOCK_QUERIES = 1 << 13
#: Queries multiplied with a tile at once.
STRIP = 512


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: components as ``floor(scale * x)`` of every vector without null or non-finite ones.

    A component beyond a long stays at its end.
    """
    x = F.col("embedding")
    fit = x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return vectors.where(fit).select("vec_id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of both: in doubles while these are exact, else in unbounded integers."""
    most = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0)) * max(left.shape[1], 1)
    if most < 2.0 ** 53:
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    if most < 2.0 ** 62:
        return left @ right.T
    return left.astype(object) @ right.T.astype(object)


def _bounds(width: int, slices: int) -> list[int]:
    return [width * j // slices for j in range(slices + 1)]


def sliced(vectors: DataFrame, width: int, slices: int) -> DataFrame:
    """``tile, slice, ids, part``: up to ``TILE`` vectors as one matrix for each slice of the components.

    Shorter vectors end in zeros.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                lists = part.column("v")
                lengths = lists.value_lengths().to_numpy()
                matrix = np.zeros((len(lengths), width), np.int64)
                matrix[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
                tile = (TaskContext.get().partitionId() << 32) + number
                number += 1
                for j, (a, b) in enumerate(zip(_bounds(width, slices), _bounds(width, slices)[1:])):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tile], pa.int64()), pa.array([j], pa.int32()),
                         pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), part.column("vec_id")),
                         pa.array([np.ascontiguousarray(matrix[:, a:b]).tobytes()], pa.binary())], ["tile", "slice", "ids", "part"])

    return vectors.mapInArrow(pack, f"tile long, slice int, ids array<{kind}>, part binary")


class Block:
    """A block of queries: their ids and, by slice, their components."""

    def __init__(self, ids: list, matrix: np.ndarray, slices: int):
        self.ids, self.bounds = ids, _bounds(matrix.shape[1], slices)
        self.parts = [np.ascontiguousarray(matrix[:, a:b]) for a, b in zip(self.bounds, self.bounds[1:])]
        self.places: dict = {}
        for q, i in enumerate(ids):
            self.places.setdefault(i, []).append(q)

    def own(self, ids: list) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``ids``, query) wherever a row has a query's own id."""
        pairs = [(p, q) for p, i in enumerate(ids) if i in self.places for q in self.places[i]]
        return np.array([p for p, _ in pairs], np.int64), np.array([q for _, q in pairs], np.int64)

    def strips(self, row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, local scores, whether they count) of one slice of a tile, some queries at a time."""
        matrix = np.frombuffer(row["part"], np.int64).reshape(len(row["ids"]), -1)
        place, query = self.own(row["ids"])
        for at in range(0, len(self.ids), STRIP):
            local = scores(matrix, self.parts[row["slice"]][at:at + STRIP])
            counts = np.ones(local.shape, bool)
            mine = (query >= at) & (query < at + STRIP)
            counts[place[mine], query[mine] - at] = False
            yield at, local, counts


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def local_lists(slices: DataFrame, shared, first: int) -> DataFrame:
    """``query, slice, score, tile, place``: of every task, the ``first`` highest local scores of each query in each slice."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best: dict = {}
        for row in _rows(batches):
            for at, local, counts in block.strips(row):
                local = np.where(counts, local, np.iinfo(np.int64).min)
                keep = min(first, len(local))
                place = np.argpartition(-local.astype(float), keep - 1, axis=0)[:keep] if keep < len(local) else np.arange(
                    len(local))[:, None].repeat(local.shape[1], 1)
                new = (np.take_along_axis(local, place, 0), np.full(place.shape, row["tile"]), place)
                old = best.get((row["slice"], at))
                if old is not None:
                    new = tuple(np.concatenate([a, b]) for a, b in zip(old, new))
                    if len(new[0]) > first:
                        top = np.argpartition(-new[0].astype(float), first - 1, axis=0)[:first]
                        new = tuple(np.take_along_axis(a, top, 0) for a in new)
                best[row["slice"], at] = new
        for (j, at), (score, tile, place) in best.items():
            there = score > np.iinfo(np.int64).min
            query = np.broadcast_to(np.arange(at, at + score.shape[1]), score.shape)[there]
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(np.full(len(query), j), pa.int32()), pa.array(score[there].tolist(), pa.int64()),
                 pa.array(tile[there], pa.int64()), pa.array(place[there], pa.int32())], ["query", "slice", "score", "tile", "place"])

    return slices.mapInArrow(work, "query int, slice int, score long, tile long, place int")


def sufficient(slices: DataFrame, shared, cutoffs) -> DataFrame:
    """``tile, queries, places``: the entries of every list whose local score reaches the query's share of the cutoff."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, share = shared.value, cutoffs.value
        for row in _rows(batches):
            for at, local, counts in block.strips(row):
                place, query = np.nonzero(counts & (local >= share[at:at + local.shape[1]]))
                if len(place):
                    ends = pa.array([0, len(place)], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["tile"]], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(query + at, pa.int32())),
                         pa.ListArray.from_arrays(ends, pa.array(place, pa.int32()))], ["tile", "queries", "places"])

    return slices.mapInArrow(work, "tile long, queries array<int>, places array<int>")


def resolved(entries: DataFrame, slices: DataFrame, shared, top: int) -> DataFrame:
    """``query, vec_id, score``: exact scores of the entries (``tile, queries, places``), each tile's ``top`` of a query.

    Every slice of the tile looks its local scores up; their sum is exact.
    """
    kind = slices.schema["ids"].dataType.elementType.simpleString()

    def unite(group: pa.Table) -> pa.Table:
        pairs = np.unique(np.concatenate([np.array(group.column(c).combine_chunks().flatten(), np.int64)[None] for c in ("queries", "places")]), axis=1)
        ends = pa.array([0, pairs.shape[1]], pa.int32())
        return pa.table({"tile": group.column("tile").slice(0, 1), "queries": pa.ListArray.from_arrays(ends, pa.array(pairs[0], pa.int32())),
                         "places": pa.ListArray.from_arrays(ends, pa.array(pairs[1], pa.int32()))})

    united = entries.groupBy("tile").applyInArrow(unite, "tile long, queries array<int>, places array<int>")
    # An entry's tile is met once per slice, where its local scores are.
    asked = united.join(slices, "tile")

    def look_up(group: pa.Table) -> pa.Table:
        block, total, rows = shared.value, 0, group.to_pylist()
        query, place = np.array(rows[0]["queries"], np.int64), np.array(rows[0]["places"], np.int64)
        for row in rows:
            matrix, part = np.frombuffer(row["part"], np.int64).reshape(len(row["ids"]), -1), block.parts[row["slice"]]
            wide = scores(np.abs(matrix).max(axis=0, initial=0)[None], np.abs(part).max(axis=0, initial=0)[None]).max(initial=0) >= 1 << 60
            left, right = (matrix.astype(object), part.astype(object)) if wide else (matrix, part)
            total = total + np.concatenate([(left[place[k:k + TILE]] * right[query[k:k + TILE]]).sum(axis=1) for k in range(0, len(place), TILE)])
        ids = np.empty(len(rows[0]["ids"]), object)
        ids[:] = rows[0]["ids"]
        order = sorted(range(len(query)), key=lambda k: (query[k], -total[k], ids[place[k]] is None, ids[place[k]] or 0))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kept = [k for k, r in zip(order, rank) if r < top]
        return pa.table({"query": pa.array(query[kept], pa.int32()), "vec_id": pa.array([ids[place[k]] for k in kept], group.schema.field("ids").type.value_type),
                         "score": pa.array([int(total[k]) for k in kept], pa.int64())})

    return asked.groupBy("tile").applyInArrow(look_up, f"query int, vec_id {kind}, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    return best_rows(found, ["query"], [F.desc("score"), F.asc_nulls_last("vec_id")], top, F.col("vec_id"))


def _search_block(spark, rows: list, slices: DataFrame, width: int, n_slices: int, top: int, first: int, id_kind: str) -> DataFrame:
    matrix = np.zeros((len(rows), width), np.int64)
    for q, r in enumerate(rows):
        matrix[q, :len(r["v"])] = r["v"]
    ids = [r["vec_id"] for r in rows]
    shared = spark.sparkContext.broadcast(Block(ids, matrix, n_slices))
    # Phase 1: the heads of the local lists, and the exact scores of what they name.
    lists = local_lists(slices, shared, first)
    heads = lists.withColumn("at", F.row_number().over(Window.partitionBy("query", "slice").orderBy(
        F.desc("score"), "tile", "place"))).where(F.col("at") <= first)
    named = heads.groupBy("tile").agg(F.collect_list(F.struct("query", "place")).alias("named")).select(
        "tile", F.col("named.query").alias("queries"), F.col("named.place").alias("places"))
    known = _best(resolved(named, slices, shared, top), top)
    lowest = known.where(F.col("rank") == top).select("query", "score").collect()  # one row for a query of the block at most
    # Phase 2: a total that reaches the cutoff reaches its share in one slice at least; queries without one take every entry.
    share = np.full(len(ids), np.iinfo(np.int64).min)
    for r in lowest:
        share[r["query"]] = -(-r["score"] // n_slices)
    entries = cut(sufficient(slices, shared, spark.sparkContext.broadcast(share)), "sufficient")
    # Phase 3: exact scores of all that is left.
    found = _best(resolved(entries, slices, shared, top), top)
    names = spark.sparkContext.broadcast(ids)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([names.value[q] for q in batch.column("query").to_pylist()], batch.schema.field("vec_id").type)
            yield pa.RecordBatch.from_arrays([own, *[batch.column(c) for c in ("rank", "vec_id", "score")]], ["query_id", "rank", "vec_id", "score"])

    return found.select("query", "rank", "vec_id", "score").mapInArrow(name, f"query_id {id_kind}, rank int, vec_id {id_kind}, score long")


def top_products(vectors: DataFrame, every: int = EVERY, top: int = TOP, slices: int = SLICES, first: int = FIRST,
                 block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by ``every``, the ``top`` others by inner product.

    Components are cut into ``slices``; each holds, for each query, a list of
    local scores (inner products of the slice), and a score is the sum over the
    slices. (1) Every slice sends the heads of its lists; what they name is scored
    exactly, and the last of a query's ``top`` is a safe cutoff. (2) The cutoff is
    broadcast; every slice sends all entries whose local score reaches
    cutoff / slices: a total that reaches the cutoff does so in one slice at
    least, whatever the signs. (3) The slices look up the remaining local
    scores of these entries. The result is exact.

    Queries go in blocks of about ``block_queries`` (chosen by hash of the id),
    which bounds what is broadcast and collected: ids, components and one
    cutoff a query. Of equal vectors only the ``top`` + 1 lowest ids are searched, and
    ``top`` rows of each; the others can't be among the best.

    Vectors that are null or hold null or non-finite components take no part; an
    empty vector scores 0; shorter ones end in zeros. Ties go to the smaller
    vec_id, null last; a null id is no query. Rows that have the query's own id
    are not its candidates; different vectors of one query id are searched each
    for itself, equal ones once. Scores beyond a long stop the job with an
    error. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    fit = cut(whole(vectors), "whole")
    # Among equal vectors: the lowest top + 1 ids, so that top remain without the query's own, and top rows of each.
    ids = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"))
    rows = Window.partitionBy("v", "vec_id").orderBy("vec_id")
    able = fit.withColumn("copy", F.dense_rank().over(ids)).where(F.col("copy") <= top + 1).withColumn(
        "copy", F.row_number().over(rows)).where(F.col("copy") <= top).drop("copy")
    asked = fit.where(F.col("vec_id") % every == 0).distinct()
    size = fit.agg(F.max(F.size("v")).alias("width")).first()
    width, queries = size["width"] or 0, asked.count()
    # A few rows hold much work: they are dealt evenly, whatever their bytes.
    tiles = cut(sliced(able, max(width, 1), slices).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "slices")
    blocks = max(1, -(-queries // block_queries))
    found = [_search_block(spark, rows, tiles, max(width, 1), slices, top, first, id_kind)
             for block in range(blocks) if (rows := asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect())]
    if not found:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score long")
    return reduce(DataFrame.unionAll, found)


SQL = """
with fit as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id,
           list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
    from (select distinct * from fit where vec_id % 50 = 0) q join fit c on c.vec_id is distinct from q.vec_id),
placed as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id::bigint as query_id, rank::int as rank, vec_id::bigint as vec_id, score from placed where rank <= 5
"""


def op12_exact_topk(spark, folder: str) -> DataFrame:
    return top_products(table(spark, folder, "embeddings"))
