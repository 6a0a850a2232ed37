"""Nearest-neighbour joins: global, inside a group, and as a graph."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.operators import ranks, tiles
from kindred.session import cut, small_table

# Driver and broadcast state of the pruned search is MAX_PIVOTS vectors and
# MAX_PIVOTS ** 2 cell pairs at most, whatever the size of the tables.
MAX_PIVOTS = 512
# Numbers held in the lists and query tiles of a task before they are sent on.
HELD = 1 << 24
# Corpus rows that about a tile of queries meets in one product. Many, so that the first tells few but the nearest.
BLOCK_ROWS = 1 << 12


def _slot_counts(df: DataFrame, keys: list[str], rows: int, n: int):
    """Tiles per key group: a small table, or one number when there are no groups.

    The table is written, so joining it is a broadcast exactly when its real size allows.
    """
    if not keys:
        return max(1, math.ceil(n / rows))
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("slots"))
    return cut(counts, "tile-counts")


def _tile(df: DataFrame, slots, keys: list[str], vec_col: str, prefix: str) -> DataFrame:
    """Pack ``df`` (columns ``keys``, ``id``, vector) into hashed tiles numbered per key group."""
    if keys:
        numbered = df.join(slots, keys)
    else:
        numbered = df.withColumn("slots", F.lit(slots))
    numbered = numbered.withColumn("slot", tiles.hash_slot("id", F.col("slots")))
    return tiles.pack(numbered, [*keys, "slot"], ["id"], vec_col, prefix)


def _near_lists(k: int, metric: str, grouped: bool, rows_of: Callable[[np.ndarray], np.ndarray] | None = None):
    """The k best of every query among all the tiles its tile meets in a task, kept while the pairs pass.

    Lists leave the task once, or when HELD entries have come together. ``rows_of(queries)``,
    called once a query tile, gives the cells each of its queries reads, so which queries a corpus tile of a ``c_cell`` is for.
    """
    def run(batches):
        held, size = {}, 0

        def sent() -> pa.RecordBatch:
            lists = list(held.values())
            columns = [pa.array(np.concatenate(v)) for v in (
                [x["ids"][x["row"]] for x in lists], [x["c"] for x in lists], [x["d"] for x in lists])]
            if grouped:
                columns.insert(0, pa.concat_arrays([pa.repeat(x["g"], len(x["row"])) for x in lists]))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["g"][:grouped] + ["q_rep", "c_rep", "dist"])

        for batch in batches:
            for row in range(batch.num_rows):
                q_ids = tiles.list_values(batch, "q_id", row)
                c_ids = tiles.list_values(batch, "c_id", row)
                key = (batch.column("g")[row].as_py() if grouped else None, int(q_ids[0]))
                if key not in held:
                    if size >= HELD:
                        yield sent()
                        size = 0
                    x = tiles.matrix(batch, "q_vec", row, len(q_ids))
                    # Copies: what views a batch keeps all of it.
                    held[key] = {"ids": q_ids.copy(), "x": x, "row": np.empty(0, np.int64), "c": np.empty(0, np.int64), "d": np.empty(0),
                                 "worst": np.full(len(q_ids), np.inf), "cells": rows_of(x) if rows_of else None,
                                 "g": pa.scalar(key[0], batch.column("g").type) if grouped else None}
                    size += len(q_ids) * (k + 3 * x.shape[1])
                at = held[key]
                for_all = at["cells"] is None
                some = None if for_all else np.flatnonzero((at["cells"] == batch.column("c_cell")[row].as_py()).any(axis=1))
                if not for_all and not len(some):
                    continue
                _keep_near(at, tiles.matrix(batch, "c_vec", row, len(c_ids)), c_ids, k, metric, some)
        if held:
            yield sent()
    return run


def _keep_near(at: dict, y: np.ndarray, c_ids: np.ndarray, k: int, metric: str, some: np.ndarray | None) -> None:
    """Merge the rows of a corpus tile into the lists of a query tile (of its rows ``some``)."""
    if "screen" not in at:
        at["screen"] = tiles.Screen(at["x"], metric)
    worst = at["worst"] if some is None else at["worst"][some]
    found = at["screen"].within(y, worst, k, some)
    if found is None:
        x = at["x"] if some is None else at["x"][some]
        d = 1.0 - tiles.cosine_block(x, y) if metric == "cosine" else tiles.euclidean_block(x, y)
        _keep_best(at, d, c_ids, k, some)
    elif len(found[0]):
        i, j, d = found
        _merge(at, i if some is None else some[i], c_ids[j], d, k)


def _keep_best(at: dict, d: np.ndarray, c_ids: np.ndarray, k: int, some: np.ndarray | None) -> None:
    """Merge a block of distances into the lists of its rows: least distance, then least id."""
    worst = at["worst"] if some is None else at["worst"][some]
    near = d <= worst[:, None]
    i, j = tiles.smallest_per_row(d, k) if near.sum() > 2 * k * len(d) else np.nonzero(near)
    if len(i):
        _merge(at, i if some is None else some[i], c_ids[j], d[i, j], k)


def _merge(at: dict, new: np.ndarray, c_ids: np.ndarray, d: np.ndarray, k: int) -> None:
    """Add entries (row, id, distance) to the lists, k a row: least distance, then least id."""
    touched = np.zeros(len(at["worst"]), dtype=bool)
    touched[new] = True
    old = touched[at["row"]]
    row, c, dist = (np.concatenate(v) for v in ((at["row"][old], new), (at["c"][old], c_ids), (at["d"][old], d)))
    order = np.lexsort((c, dist, row))
    row, c, dist = row[order], c[order], dist[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    last = place == k - 1
    at["worst"][row[last]] = dist[last]
    first = place < k
    for name, values in (("row", row), ("c", c), ("d", dist)):
        at[name] = np.concatenate([at[name][~old], values[first]])


def _run_pairs(q_tiles: DataFrame, c_tiles: DataFrame, partners, q_keys: list[str], c_keys: list[str],
               k: int, metric: str, g_type: T.DataType | None) -> DataFrame:
    """Written query tiles against the written corpus tiles named by ``partners``, k per query and task.

    ``partners`` has the query tile's keys and the corpus tile's keys; a query tile is
    joined to the list of its corpus cells, not to their tiles.
    """
    group = ["g"] if g_type is not None else []
    near, far = ([key for key in keys if key not in group] for keys in (q_keys, c_keys))
    if near:
        wanted = partners.groupBy(*q_keys).agg(F.collect_list(far[0]).alias("wanted"))
        q_tiles, c_tiles = q_tiles.join(wanted, q_keys), c_tiles.withColumnRenamed(far[0], "c_cell")
    return _search_tiles(q_tiles, c_tiles, k, metric, g_type)


def _search_tiles(q_tiles: DataFrame, c_tiles: DataFrame, k: int, metric: str, g_type: T.DataType | None = None,
                  rows_of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """k per query and task out of the pairs of tiles of a group; with a column ``wanted`` of those ``c_cell``s only."""
    group = ["g"] if g_type is not None else []
    fields = [T.StructField("g", g_type)] if group else []
    schema = T.StructType([*fields, T.StructField("q_rep", T.LongType()),
                           T.StructField("c_rep", T.LongType()), T.StructField("dist", T.DoubleType())])
    cells = "wanted" in q_tiles.columns
    kinds = {df.schema[f"{p}_vec"].dataType.simpleString() for df, p in ((q_tiles, "q"), (c_tiles, "c"))}

    def side(df: DataFrame, p: str, cell: str) -> DataFrame:
        vec = F.col(f"{p}_vec") if len(kinds) == 1 else F.col(f"{p}_vec").cast("array<double>")
        return df.select(*group, F.col(f"{p}_id").alias("id"), vec.alias("vec"), *[cell][:cells])

    dealt = tiles.stream(side(q_tiles, "q", "wanted"), side(c_tiles, "c", "c_cell"), group, F.col("id")[0], F.col("id")[0])
    return dealt.mapInArrow(_near_parts(k, metric, bool(group), cells, rows_of), schema)


def _near_parts(k: int, metric: str, grouped: bool, cells: bool, rows_of: Callable[[np.ndarray], np.ndarray] | None = None):
    """The k best of every query among the corpus rows of each part that its tile meets (``tiles.stream``).

    With ``cells`` a query tile reads the ``c_cell``s it has ``wanted``, a query those that ``rows_of`` says.
    """
    def take(batch: pa.RecordBatch, row: int) -> dict:
        ids = tiles.list_values(batch, "id", row).copy()
        got = {"ids": ids, "x": tiles.list_values(batch, "vec", row).reshape(len(ids), -1).copy()}
        if cells:
            got["cell"], wanted = batch.column("c_cell")[row].as_py(), batch.column("wanted")[row]
            got["wanted"] = set(wanted.as_py() or ())
        return got

    def blocks(held: list[dict]) -> dict:
        """Cell -> (ids, rows) of BLOCK_ROWS each, whatever the tiles they came in."""
        by_cell, out = {}, {}
        while held:
            tile = held.pop()
            by_cell.setdefault(tile.get("cell"), []).append(tile)
        for cell, some in by_cell.items():
            ids, x = (np.concatenate([t[n] for t in some]) for n in ("ids", "x"))
            some.clear()
            out[cell] = [(ids[at:at + BLOCK_ROWS], x[at:at + BLOCK_ROWS]) for at in range(0, len(ids), BLOCK_ROWS)]
        return out

    def run(batches):
        g_type, corpus, last, waiting = None, {}, None, []

        def searched(key: tuple) -> pa.RecordBatch:
            ids, x = (np.concatenate([t[n] for t in waiting]) for n in ("ids", "x"))
            x = x.astype(np.float64)
            at = {"x": x, "row": np.empty(0, np.int64), "c": np.empty(0, np.int64), "d": np.empty(0), "worst": np.full(len(ids), np.inf)}
            reads = rows_of(x) if rows_of else None
            for cell, some in corpus.items():
                if cells and cell not in waiting[0]["wanted"]:
                    continue
                rows = None if reads is None else np.flatnonzero((reads == cell).any(axis=1))
                if rows is not None and not len(rows):
                    continue
                for c_ids, y in some:
                    _keep_near(at, y.astype(np.float64), c_ids, k, metric, rows)
            waiting.clear()
            columns = [pa.array(ids[at["row"]]), pa.array(at["c"]), pa.array(at["d"])]
            if grouped:
                columns.insert(0, pa.repeat(pa.scalar(key[0], g_type), len(at["row"])))
            return pa.RecordBatch.from_arrays(columns, names=["g"][:grouped] + ["q_rep", "c_rep", "dist"])

        def seen():
            nonlocal g_type
            for batch in batches:
                g_type = batch.schema.field("g").type if grouped else None
                yield batch

        key = ()
        for now, held, tile in tiles.passing(seen(), ["g"][:grouped], take):
            if held is not last:
                if waiting:
                    yield searched(key)
                key, last, corpus = now, held, blocks(held)
            waiting.append(tile)
            # Tiles that read all cells are searched together, about TILE_ROWS rows at once.
            if cells or sum(len(t["ids"]) for t in waiting) >= tiles.TILE_ROWS:
                yield searched(key)
        if waiting:
            yield searched(key)
    return run


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _choose_pivots(corpus: DataFrame, vec_col: str, count: int, metric: str) -> np.ndarray:
    """``count`` vectors picked by hash; they only steer pruning, never the result."""
    has_length = F.exists(F.col(vec_col), lambda x: x != 0)
    rows = (corpus.where(has_length).orderBy(F.xxhash64("id"), "id").limit(count)
            .select(vec_col).collect())
    pivots = np.array([r[0] for r in rows], dtype=np.float64)
    return _unit(pivots) if metric == "cosine" else pivots


def _assign(df: DataFrame, vec_col: str, pivots: np.ndarray, metric: str) -> DataFrame:
    """Nearest pivot (``cell``) and distance to it (``reach``)."""
    @F.pandas_udf("cell int, reach double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        if metric == "cosine":
            x = _unit(x)
        d = tiles.euclidean_block(x, pivots)
        if metric == "cosine":
            # A vector without length has similarity 0 to all: right angles.
            d[~x.any(axis=1)] = math.sqrt(2.0)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "reach": d[np.arange(len(d)), cell]})

    tagged = df.withColumn("_near", nearest(vec_col))
    return tagged.select(*df.columns, "_near.cell", "_near.reach")


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine",
             by: str | None = None, id_col: str = "idx_global", vec_col: str = "embedding",
             query_id: str = "query_id", query_vec: str = "embedding",
             exclude_self: bool = False, pivots: int | None = None,
             tile_rows: int = tiles.TILE_ROWS, search: Callable[..., DataFrame] | None = None) -> DataFrame:
    """The ``k`` nearest corpus rows of every query row, exactly.

    Order is distance, then corpus id. ``by`` limits a query to the corpus rows
    of its own group. Returns ``[by,] query_id, idx_global, dist, rank`` (for
    cosine, ``dist`` is 1 - similarity).

    Steps: merge equal vectors on both sides; pack them into tiles; one matrix
    product per tile pair, a task keeping k per query over all its pairs; merge by
    ranked window; spread the result over the copies. With ``pivots`` > 1 vectors are first grouped by
    nearest pivot; each query cell is searched in its own cell, and the k-th
    distance found there bounds which other cells can hold anything nearer
    (triangle inequality). Cells beyond the bound are skipped, with the same
    result as a full search.

    ``search`` takes the place of the tile pairs: ``cells.grid_pairs`` (exact, for few
    dimensions), ``group_cells.pivot_pairs`` (exact, with ``by``) or ``inverted.probing(...)``
    (approximate). It gets the different
    vectors of both sides, the group columns, k, the metric and the rows of a tile.
    """
    group = ["g"] if by else []
    head = [F.col(by).alias("g")] if by else []
    q = queries.select(*head, F.col(query_id).alias("q_id"), F.col(query_vec).alias("q_vec"))
    c = corpus.select(*head, F.col(id_col).alias("c_id"), F.col(vec_col).alias("c_vec"))
    g_type = q.schema["g"].dataType if by else None
    need = k + 1 if exclude_self else k

    reps = tiles.write_distinct(q, group, "q_id", "q_vec", "knn-queries")
    vectors = tiles.write_distinct(c, group, "c_id", "c_vec", "knn-corpus")
    asked, stored = reps.select(*group, "id", "q_vec"), vectors.select(*group, "id", "c_vec")
    # Row counts come off the file footers.
    n_q, n_c = (0, 0) if by or search else (reps.count(), vectors.count())
    if search:
        best = search(asked, stored, group, need, metric, tile_rows)
    elif pivots is not None and pivots > 1 and not by and n_c:
        best = _pruned_pairs(asked, stored, need, metric, min(pivots, MAX_PIVOTS), tile_rows)
    else:
        c_slots = _slot_counts(stored, group, tile_rows, n_c)
        q_tiles = cut(_tile(asked, _slot_counts(asked, group, tile_rows, n_q), group, "q_vec", "q_"), "knn-q-tiles")
        c_tiles = cut(_tile(stored, c_slots, group, "c_vec", "c_"), "knn-c-tiles")
        best = _run_pairs(q_tiles, c_tiles, c_slots, group, group, need, metric, g_type)

    merged = ranks.top_n(best, [*group, "q_rep"], [F.col("dist"), F.col("c_rep")], need, "_r").drop("_r")
    # Back from different vectors to rows: first the copies of the corpus side. Of a
    # set of copies only the ``need`` lowest ids can be among the nearest rows ...
    copies = tiles.copies_of(c, vectors, group, "c_id", "c_vec", need).withColumnRenamed("rep", "c_rep")
    found = merged.join(copies, [*group, "c_rep"], "left").withColumn("c_id", F.coalesce("c_id", "c_rep"))
    found = ranks.top_n(found, [*group, "q_rep"], [F.col("dist"), F.col("c_id")], need, "_r")
    lists = found.groupBy(*group, "q_rep").agg(
        F.sort_array(F.collect_list(F.struct("dist", "c_id"))).alias("_near"))
    # ... then the copies of the query side, each minus itself where asked.
    named = tiles.with_rep(q, reps, group, "q_id", "q_vec", "q_rep")
    near = F.col("_near")
    if exclude_self:
        near = F.filter(near, lambda x: x["c_id"] != F.col("q_id"))
    return (
        named.join(lists, [*group, "q_rep"])
        .select(*group, "q_id", F.posexplode(F.slice(near, 1, k)).alias("_pos", "_hit"))
        .select(*([F.col("g").alias(by)] if by else []), F.col("q_id").alias(query_id),
                F.col("_hit.c_id").alias(id_col), F.col("_hit.dist").alias("dist"),
                (F.col("_pos") + 1).cast("long").alias("rank"))
    )


def _pruned_pairs(reps: DataFrame, vectors: DataFrame, need: int, metric: str, count: int,
                  tile_rows: int) -> DataFrame:
    points = _choose_pivots(vectors, "c_vec", count, metric)
    if not len(points):
        points = np.zeros((1, reps.select(F.size("q_vec")).first()[0]))
    q = cut(_assign(reps, "q_vec", points, metric), "knn-query-cells")
    c = cut(_assign(vectors.select("id", "c_vec"), "c_vec", points, metric), "knn-corpus-cells")
    keys = ["cell"]
    c_slots = _slot_counts(c, keys, tile_rows, 0)
    q_tiles = cut(_tile(q.drop("reach"), _slot_counts(q, keys, tile_rows, 0), keys, "q_vec", "q_"), "knn-q-tiles")
    c_tiles = cut(_tile(c.drop("reach"), c_slots, keys, "c_vec", "c_"), "knn-c-tiles")
    first = cut(_run_pairs(q_tiles, c_tiles, c_slots, keys, keys, need, metric, None), "knn-own")

    # Upper bound per query cell: the worst k-th distance found in the own cell.
    kth = (
        ranks.top_n(first, ["q_rep"], [F.col("dist"), F.col("c_rep")], need, "_r")
        .groupBy("q_rep").agg(F.max("dist").alias("dist"), F.count(F.lit(1)).alias("_n"))
    )
    as_length = F.sqrt(F.lit(2.0) * F.greatest(F.col("dist"), F.lit(0.0))) if metric == "cosine" \
        else F.col("dist")
    bound = F.when(F.col("_n") >= need, as_length).otherwise(F.lit(float("inf")))
    q_cells = (
        q.join(kth, q["id"] == kth["q_rep"], "left").groupBy("cell")
        .agg(F.max(F.coalesce(bound, F.lit(float("inf")))).alias("bound"),
             F.max("reach").alias("reach")).collect()
    )
    c_cells = c.groupBy("cell").agg(F.max("reach").alias("reach"),
                                    F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).alias("slots")).collect()
    # At most MAX_PIVOTS rows on each side: metadata, not data.
    apart = tiles.euclidean_block(points, points)
    pairs = [
        (a["cell"], b["cell"], int(b["slots"]))
        for a in q_cells for b in c_cells
        if a["cell"] != b["cell"]
        and apart[a["cell"], b["cell"]] - a["reach"] - b["reach"] <= a["bound"] + 1e-9
    ]
    if not pairs:
        return first
    partners = small_table(reps.sparkSession, pairs, "cell int, c_cell int, slots long")
    rest = _run_pairs(q_tiles, c_tiles.withColumnRenamed("cell", "c_cell"), partners,
                      keys, ["c_cell"], need, metric, None)
    return first.unionByName(rest)


def suggested_pivots(rows: int, tile_rows: int = tiles.TILE_ROWS) -> int:
    """One cell per few tiles, none for tables of a few tiles."""
    return 1 if rows < 16 * tile_rows else min(MAX_PIVOTS, int(math.sqrt(rows / 4)))


def knn_graph(df: DataFrame, k: int, metric: str = "cosine", by: str | None = None,
              id_col: str = "idx_global", vec_col: str = "embedding", **kw) -> DataFrame:
    """``id_col, neighbour, dist, rank``: the k nearest other rows of each row."""
    keep = [by] if by else []
    renamed = df.select(*keep, F.col(id_col).alias("query_id"), F.col(vec_col).alias("embedding"))
    hits = knn_join(renamed, df, k, metric, by=by, id_col=id_col, vec_col=vec_col,
                    exclude_self=True, **kw)
    return hits.select(*keep, F.col("query_id").alias("_me"), F.col(id_col).alias("neighbour"),
                       "dist", "rank").withColumnRenamed("_me", id_col)


def core_distance(graph: DataFrame, min_samples: int, by: str | None = None,
                  id_col: str = "idx_global") -> DataFrame:
    """Distance to the ``min_samples``-th neighbour, read off a stored graph."""
    keep = [by] if by else []
    return graph.where(F.col("rank") == min_samples).select(*keep, id_col, F.col("dist").alias("core"))


def mutual_reach(graph: DataFrame, core: DataFrame, by: str | None = None,
                 id_col: str = "idx_global") -> DataFrame:
    """Undirected edges ``a < b`` with weight max(core_a, core_b, distance)."""
    keep = [by] if by else []
    edges = graph.groupBy(
        *keep, F.least(id_col, "neighbour").alias("a"), F.greatest(id_col, "neighbour").alias("b")
    ).agg(F.min("dist").alias("dist"))
    a = core.select(*keep, F.col(id_col).alias("a"), F.col("core").alias("core_a"))
    b = core.select(*keep, F.col(id_col).alias("b"), F.col("core").alias("core_b"))
    return (edges.join(a, [*keep, "a"]).join(b, [*keep, "b"])
            .select(*keep, "a", "b", F.greatest("core_a", "core_b", "dist").alias("w")))


def group_topk(queries: DataFrame, corpus: DataFrame, n: int = 10, label: str = "label",
               id_col: str = "idx_global", vec_col: str = "embedding",
               query_id: str = "query_id", **kw) -> DataFrame:
    """Most similar rows of the query's own group, with relative and global index.

    Groups no query asks for are left out before anything is grouped or tiled.
    ``search=group_cells.pivot_pairs`` skips the parts of a group too far from a query.
    """
    corpus = ranks.in_asked_groups(corpus, queries, label)
    hits = knn_join(queries, corpus, n, "cosine", by=label, id_col=id_col, vec_col=vec_col,
                    query_id=query_id, **kw)
    index = ranks.relative_index(corpus.select(label, id_col), [label], id_col)
    return hits.join(index, [label, id_col]).select(
        query_id, label, "rank", "idx_relativo", F.col(id_col),
        (F.lit(1.0) - F.col("dist")).alias("similarity"))


def global_topk(queries: DataFrame, corpus: DataFrame, n: int = 5, label: str = "label",
                id_col: str = "idx_global", vec_col: str = "embedding",
                query_id: str = "query_id", pivots: int | None = None) -> DataFrame:
    """Most similar rows of the whole corpus and the groups they belong to."""
    hits = knn_join(queries, corpus, n, "cosine", id_col=id_col, vec_col=vec_col,
                    query_id=query_id, pivots=pivots)
    return hits.join(corpus.select(id_col, label), id_col).select(
        query_id, "rank", F.col(id_col), label, (F.lit(1.0) - F.col("dist")).alias("similarity"))


def knn_vote(hits: DataFrame, label: str = "label", query_id: str = "query_id") -> DataFrame:
    """Majority label of each query's hits; ties to the lower label."""
    votes = hits.groupBy(query_id, label).agg(F.count(F.lit(1)).alias("votes"))
    best = F.min_by(F.struct(F.col(label).alias("label"), "votes"),
                    F.struct(-F.col("votes"), F.col(label)))
    return votes.groupBy(query_id).agg(best.alias("_b")).select(
        query_id, F.col("_b.label").alias("predicted"), F.col("_b.votes").alias("votes"))
