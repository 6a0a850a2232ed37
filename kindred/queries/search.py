"""Nearest neighbours, exact matches, hits and their source rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import cells, classify, exact, graph, group_cells, heldout, inverted, neighbours, reduce
from kindred.sources.observations import fetch_rows
from kindred.plans import prediction
from kindred.queries.tables import E_SQL, load, r6, vectors
from kindred.queries.text import _ngram_sql

K = 15
MIN_SAMPLES = 5
EPS = 1.15
# The given vectors have little structure: of 45 lists (sf0.1) 32 give a recall of 0.95, 16 of 0.74.
INVERTED_PROBES = 32


def _as_queries(df):
    return df.select(F.col("idx_global").alias("query_id"), "label", "embedding")


def group_topk(spark, folder):
    """Ten most similar rows of its own group for every vector."""
    e = vectors(spark, folder)
    hits = neighbours.group_topk(_as_queries(e), e, 10)
    return hits.select("query_id", "label", "rank", "idx_relativo", "idx_global",
                       r6("similarity").alias("similarity"))


def pruned_groups(spark, folder):
    """The search inside groups with pivot cells of each group: same rows, cells beyond the bound never compared."""
    e = vectors(spark, folder)
    hits = neighbours.group_topk(_as_queries(e), e, 10, search=group_cells.pivot_pairs, tile_rows=32)
    return hits.select("query_id", "label", "rank", "idx_relativo", "idx_global",
                       r6("similarity").alias("similarity"))


def heldout_neighbours(spark, folder):
    """The five nearest trained vectors of every held-out one, three folds at once."""
    _, held = heldout.fold_neighbours(heldout.fold_vectors(vectors(spark, folder), 3), 5, 3)
    return held.select("fold", "node", "rank", "neighbour", r6("dist").alias("dist"))


def global_topk(spark, folder):
    """Five most similar rows of the whole table and their groups."""
    e = vectors(spark, folder)
    hits = neighbours.global_topk(_as_queries(e).drop("label"), e, 5)
    return hits.select("query_id", "rank", "idx_global", "label", r6("similarity").alias("similarity"))


def _other_side(df):
    """Every vector shifted by a constant: queries that are near, but not in, the table."""
    moved = F.transform("embedding", lambda x: (x.cast("double") + F.lit(0.01)).cast("float"))
    return df.select(F.col("idx_global").alias("query_id"), moved.alias("embedding"))


def nearest_label(spark, folder):
    """Most similar row, and its group, for shifted vectors."""
    e = vectors(spark, folder)
    hits = neighbours.global_topk(_other_side(e), e, 1)
    return hits.select("query_id", "idx_global", F.col("label").alias("predicted"),
                       r6("similarity").alias("similarity"))


def pruned_topk(spark, folder):
    """The global search with pivot cells: same rows, cells beyond the bound never compared."""
    e = vectors(spark, folder)
    hits = neighbours.global_topk(_as_queries(e).drop("label"), e, 5, pivots=8)
    return hits.select("query_id", "rank", "idx_global", "label", r6("similarity").alias("similarity"))


def knn_vote(spark, folder):
    e = vectors(spark, folder)
    near = neighbours.knn_graph(e, 5, "cosine").withColumnRenamed("idx_global", "query_id")
    labelled = near.join(e.select(F.col("idx_global").alias("neighbour"), "label"), "neighbour")
    return neighbours.knn_vote(labelled)


def _match_queries(e):
    """Each vector as it is, moved by 1e-8 (within tolerance) and by 1e-2 (outside)."""
    parts = []
    for i, move in enumerate((0.0, 1e-8, 1e-2)):
        parts.append(e.select(
            (F.col("idx_global") * 3 + i).alias("query_id"), "label",
            F.transform("embedding", lambda x: (x.cast("double") + F.lit(move)).cast("float")).alias("embedding")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def exact_match(spark, folder):
    e = vectors(spark, folder)
    return exact.exact_match(_match_queries(e), e)


def hydrate_hits(spark, folder):
    """Hits joined to a source table that lacks some of the ids."""
    e = vectors(spark, folder)
    hits = neighbours.global_topk(_as_queries(e).drop("label"), e, 5)
    source = load(spark, folder, "labels").select(F.col("doc_id").alias("idx_global"), "quality", "toxic")
    return fetch_rows(hits, source).select("query_id", "rank", "idx_global", "quality", "toxic", "found")


def similar_documents(spark, folder):
    """Documents nearest to each document by their encoded text (whole texts, copies included)."""
    from kindred.operators.encode import embed
    from kindred.session import cut
    d = cut(embed(load(spark, folder, "documents").select(F.col("doc_id").alias("idx_global"), "text"), "text")
            .drop("text"), "doc-vectors")
    near = neighbours.knn_graph(d, 3, "cosine")
    return near.select("idx_global", "rank", "neighbour", r6("dist").alias("dist"))


def predict_rows(spark, folder):
    """Nearest-centroid group of every vector and shifted vector, then exact hit or ten most similar."""
    e = vectors(spark, folder)
    asked = e.select((F.col("idx_global") * 2).alias("idx_global"), "embedding", "label").unionByName(
        _other_side(e).select((F.col("query_id") * 2 + 1).alias("idx_global"), "embedding", F.lit(0).alias("label")))
    centroids = classify.centroid_table(e).withColumnRenamed("label", "c_label")
    near = neighbours.knn_join(asked.select(F.col("idx_global").alias("query_id"), "embedding"), centroids, 1,
                               "cosine", id_col="c_label", vec_col="centroid")
    scored = asked.select(F.col("idx_global").alias("query_id"), "embedding").join(
        near.select("query_id", F.col("c_label").cast("int").alias("predicted")), "query_id")
    _, hits = prediction.search_predicted(scored, e)
    return hits.select("query_id", "label", "exact", "rank", "idx_relativo", "idx_global",
                       r6("similarity").alias("similarity"))


def _graph(spark, folder):
    return neighbours.knn_graph(vectors(spark, folder), K, "euclidean")


def knn_graph(spark, folder):
    return _graph(spark, folder).select("idx_global", "rank", "neighbour", r6("dist").alias("dist"))


def core_distance(spark, folder):
    return neighbours.core_distance(_graph(spark, folder), 10).select("idx_global", r6("core").alias("core"))


def _edges(spark, folder):
    near = _graph(spark, folder)
    return neighbours.mutual_reach(near, neighbours.core_distance(near, MIN_SAMPLES))


def mutual_reach_edges(spark, folder):
    return _edges(spark, folder).select("a", "b", r6("w").alias("w"))


def components_at_eps(spark, folder):
    return graph.components_within(_edges(spark, folder), vectors(spark, folder), EPS).select(
        "idx_global", "component")


def spanning_forest(spark, folder):
    # Weights equal to six digits count as ties, which go to the lower ids.
    forest, _ = graph.spanning_forest(_edges(spark, folder).withColumn("w", r6("w")))
    return forest.select("a", "b", "w")


def _first_coords(e, n):
    return e.select("idx_global", F.slice(F.col("embedding").cast("array<double>"), 1, n).alias("coords"))


def _low(spark, folder):
    """Coordinates of few dimensions, as layouts have."""
    e = vectors(spark, folder)
    return _first_coords(e, 3).withColumnRenamed("coords", "embedding").join(e.select("idx_global", "label"), "idx_global")


def grid_core(spark, folder):
    """Distance to the tenth neighbour in three dimensions, by cells."""
    near = neighbours.knn_graph(_low(spark, folder), 10, "euclidean", search=cells.grid_pairs, tile_rows=64)
    return neighbours.core_distance(near, 10).select("idx_global", r6("core").alias("core"))


def grid_groups(spark, folder):
    """The five nearest of the own label in three dimensions, by cells of each label."""
    near = neighbours.knn_graph(_low(spark, folder), 5, "euclidean", by="label", search=cells.grid_pairs, tile_rows=32)
    return near.select("idx_global", "label", "rank", r6("dist").alias("dist"))


def inverted_full(spark, folder):
    """The neighbour graph by inverted lists, all lists read: nothing is missed."""
    near = neighbours.knn_graph(vectors(spark, folder), K, "euclidean", search=inverted.probing(probes=6, cells=6), tile_rows=128)
    return near.select("idx_global", "rank", r6("dist").alias("dist"))


def inverted_recall(spark, folder):
    """How much of the exact neighbour graph inverted lists find, by rank."""
    found = neighbours.knn_graph(vectors(spark, folder), K, "euclidean", search=inverted.probing(probes=INVERTED_PROBES), tile_rows=128)
    return inverted.recall(found, _graph(spark, folder)).select("rank", "n", "found", "recall")


def cluster_map(spark, folder):
    e = vectors(spark, folder)
    made = reduce.cluster_map(_first_coords(e, 2), e.select("idx_global", F.col("cl").alias("label")), 0.05)
    return made.select("x_bin", "y_bin", "label", "n", "is_noise")


def place_new(spark, folder):
    """Coordinates of shifted vectors from the coordinates of their neighbours."""
    e = vectors(spark, folder)
    new = _other_side(e).withColumnRenamed("query_id", "idx_global")
    out = reduce.place_new(new, e, _first_coords(e, 3), K)
    return out.select("idx_global", *[r6(F.col("coords")[i]).alias(f"c{i}") for i in range(3)])


_COS = "list_cosine_similarity({}, {})"
_MOVED = "list_transform(v, lambda x: (x + 0.01)::float::double)"
_NEAR = ("near as (select a.id as id, b.id as nb, list_distance(a.v, b.v) as d, row_number() over "
         f"(partition by a.id order by list_distance(a.v, b.v), b.id) as rank from e a join e b on a.id <> b.id qualify rank <= {K})")
_LOW = ("low as (select id, label, v[1:3] as v from e), near as (select a.id as id, a.label as label, list_distance(a.v, b.v) as d, "
        "row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as rank from low a join low b on {} qualify rank <= {})")
_CORE = f"core as (select id, d as c from near where rank = {MIN_SAMPLES})"
_EDGES = ("edges as (select a, b, greatest(x.c, y.c, d) as w from (select least(id, nb) as a, greatest(id, nb) as b, "
          "min(d) as d from near group by 1, 2) join core x on x.id = a join core y on y.id = b)")
_TOP5 = ("hits as (select a.id as query_id, row_number() over (partition by a.id order by "
         f"{_COS.format('a.v', 'b.v')} desc, b.id) as rank, b.id as idx_global, b.label, "
         f"{_COS.format('a.v', 'b.v')} as s from e a cross join e b qualify rank <= 5)")
_REL = "rel as (select id, row_number() over (partition by label order by id) - 1 as r from e)"
_CENTROIDS = ("m as (select label, i, avg(x) as x from (select label, unnest(v) as x, "
              "generate_subscripts(v, 1) as i from e) group by label, i), "
              "cen as (select label, list(x order by i) as c from m group by label)")
_CLOSE = ("list_bool_and(list_transform(list_zip(q.v, b.v), "
          "lambda z: abs(z[1] - z[2]) <= 1e-6 + 1e-5 * abs(z[2])))")
_GROUPS = (f"with {E_SQL}, {_REL} select a.id as query_id, a.label as label, row_number() over "
           f"(partition by a.id order by {_COS.format('a.v', 'b.v')} desc, b.id) as rank, r as idx_relativo, "
           f"b.id as idx_global, round({_COS.format('a.v', 'b.v')}, 6) + 0.0 as similarity "
           "from e a join e b on a.label = b.label join rel on rel.id = b.id qualify rank <= 10")

QUERIES = {
    "group_topk": (group_topk, _GROUPS),
    "pruned_groups": (pruned_groups, _GROUPS),
    "heldout_neighbours": (heldout_neighbours, f"with {E_SQL}, f as (select min(id) over (partition by v) as node, v, "
                           "((row_number() over (order by id) - 1) * 3 // count(*) over ())::int as fold from e), "
                           "m as (select distinct node, fold, v from f), p as (select distinct a.fold, a.node, a.v, b.node as neighbour, b.v as w "
                           f"from m a join m b on a.fold <> b.fold) select fold, node, row_number() over (partition by fold, node order by "
                           f"{_COS.format('v', 'w')} desc, neighbour) as rank, neighbour, round(1 - {_COS.format('v', 'w')}, 6) + 0.0 as dist "
                           "from p qualify rank <= 5"),
    "global_topk": (global_topk, f"with {E_SQL}, {_TOP5} select query_id, rank, idx_global, label, "
                    "round(s, 6) + 0.0 as similarity from hits"),
    "pruned_topk": (pruned_topk, f"with {E_SQL}, {_TOP5} select query_id, rank, idx_global, label, "
                    "round(s, 6) + 0.0 as similarity from hits"),
    "nearest_label": (nearest_label, f"with {E_SQL}, q as (select id, {_MOVED} as v from e) "
                      "select q.id as query_id, b.id as idx_global, b.label as predicted, "
                      f"round({_COS.format('q.v', 'b.v')}, 6) + 0.0 as similarity from q cross join e b "
                      f"qualify row_number() over (partition by q.id order by {_COS.format('q.v', 'b.v')} desc, b.id) = 1"),
    "knn_vote": (knn_vote, f"with {E_SQL}, near as (select a.id as id, b.label as label, row_number() over (partition by a.id "
                 f"order by {_COS.format('a.v', 'b.v')} desc, b.id) as rank from e a join e b on a.id <> b.id qualify rank <= 5), "
                 "votes as (select id, label, count(*) as votes from near group by all) "
                 "select id as query_id, label as predicted, votes from votes "
                 "qualify row_number() over (partition by id order by votes desc, label) = 1"),
    "exact_match": (exact_match, f"with {E_SQL}, {_REL}, q as ("
                    + " union all ".join(
                        f"select id * 3 + {i} as query_id, label, list_transform(v, lambda x: (x + {m})::float::double) as v from e"
                        for i, m in enumerate(("0.0", "1e-8", "1e-2")))
                    + f"), hit as (select q.query_id, min(b.id) as id from q join e b on q.label = b.label where {_CLOSE} "
                    "group by q.query_id) select q.query_id, q.label, hit.id is not null as found, rel.r as idx_relativo, "
                    "hit.id as idx_global from q left join hit using (query_id) left join rel on rel.id = hit.id"),
    "hydrate_hits": (hydrate_hits, f"with {E_SQL}, {_TOP5} select query_id, rank, idx_global, quality, toxic, "
                     "doc_id is not null as found from hits left join labels on doc_id = idx_global"),
    "similar_documents": (similar_documents, f"with {_ngram_sql('documents', 'doc_id', 'text')}, "
                          "slots as (select k, l, unnest(range(64)) as bucket from lens), "
                          "e as (select k as id, list(coalesce((c / l)::float::double, 0.0) order by bucket) as v "
                          "from slots left join grams using (k, bucket) group by k) "
                          "select a.id as idx_global, row_number() over (partition by a.id order by "
                          f"{_COS.format('a.v', 'b.v')} desc, b.id) as rank, b.id as neighbour, "
                          f"round(1 - {_COS.format('a.v', 'b.v')}, 6) + 0.0 as dist from e a join e b on a.id <> b.id "
                          "qualify rank <= 3"),
    "predict_rows": (predict_rows, f"with {E_SQL}, {_REL}, {_CENTROIDS}, q0 as (select id * 2 as query_id, v from e union all "
                     f"select id * 2 + 1, {_MOVED} from e), q as (select query_id, v, label from (select query_id, v, label, "
                     f"row_number() over (partition by query_id order by {_COS.format('v', 'c')} desc, label) as r "
                     "from q0 cross join cen) where r = 1), "
                     f"hit as (select q.query_id, min(b.id) as id from q join e b on q.label = b.label where {_CLOSE} group by q.query_id), "
                     "sim as (select q.query_id, q.label, row_number() over (partition by q.query_id order by "
                     f"{_COS.format('q.v', 'b.v')} desc, b.id) as rank, b.id as id, {_COS.format('q.v', 'b.v')} as s "
                     "from q join e b on q.label = b.label where q.query_id not in (select query_id from hit) qualify rank <= 10) "
                     "select query_id, label, exact, rank, r as idx_relativo, id as idx_global, s as similarity from ("
                     "select q.query_id, q.label, true as exact, 1 as rank, hit.id, 1.0::double as s from q join hit using (query_id) "
                     "union all select query_id, label, false, rank, id, round(s, 6) + 0.0 from sim) join rel using (id)"),
    "knn_graph": (knn_graph, f"with {E_SQL}, {_NEAR} select id as idx_global, rank, nb as neighbour, "
                  "round(d, 6) + 0.0 as dist from near"),
    "core_distance": (core_distance, f"with {E_SQL}, {_NEAR} select id as idx_global, round(d, 6) + 0.0 as core "
                      "from near where rank = 10"),
    "mutual_reach_edges": (mutual_reach_edges, f"with {E_SQL}, {_NEAR}, {_CORE}, {_EDGES} "
                           "select a, b, round(w, 6) + 0.0 as w from edges"),
    "components_at_eps": (components_at_eps, f"with recursive {E_SQL}, {_NEAR}, {_CORE}, {_EDGES}, "
                          f"both_ways as materialized (select a, b from edges where w <= {EPS} union all "
                          f"select b, a from edges where w <= {EPS}), "
                          "reach(id, other) as (select id, id from e union select r.id, s.b from reach r "
                          "join both_ways s on r.other = s.a) "
                          "select id as idx_global, min(other) as component from reach group by id"),
    # An edge belongs if no path of earlier edges (by weight, then ends) joins its ends.
    "spanning_forest": (spanning_forest, f"with recursive {E_SQL}, {_NEAR}, {_CORE}, {_EDGES}, "
                        "ordered as materialized (select a, b, round(w, 6) + 0.0 as w, row_number() over "
                        "(order by round(w, 6), a, b) as o from edges), "
                        "steps as materialized (select a as x, b as y, o from ordered union all select b, a, o from ordered), "
                        "reach(o, x) as (select o, a from ordered union select r.o, s.y from reach r "
                        "join steps s on s.x = r.x and s.o < r.o) "
                        "select a, b, w from ordered where not exists "
                        "(select 1 from reach r where r.o = ordered.o and r.x = ordered.b)"),
    "grid_core": (grid_core, f"with {E_SQL}, {_LOW.format('a.id <> b.id', 10)} select id as idx_global, round(d, 6) + 0.0 as core "
                  "from near where rank = 10"),
    "grid_groups": (grid_groups, f"with {E_SQL}, {_LOW.format('a.id <> b.id and a.label = b.label', 5)} select id as idx_global, "
                    "label, rank, round(d, 6) + 0.0 as dist from near"),
    "inverted_full": (inverted_full, f"with {E_SQL}, {_NEAR} select id as idx_global, rank, round(d, 6) + 0.0 as dist from near"),
    "inverted_recall": (inverted_recall, None),
    "cluster_map": (cluster_map, f"with {E_SQL} select floor(v[1] / 0.05)::bigint as x_bin, floor(v[2] / 0.05)::bigint as y_bin, "
                    "cl as label, count(*) as n, cl = -1 as is_noise from e group by 1, 2, cl"),
    "place_new": (place_new, f"with {E_SQL}, q as (select id, {_MOVED} as v from e), near as (select q.id as id, b.v as bv, "
                  f"1 - {_COS.format('q.v', 'b.v')} as d from q cross join e b qualify row_number() over (partition by q.id "
                  f"order by {_COS.format('q.v', 'b.v')} desc, b.id) <= {K}) select id as idx_global, "
                  + ", ".join(f"round(sum(bv[{i + 1}] / (d + 1e-9)) / sum(1 / (d + 1e-9)), 6) + 0.0 as c{i}" for i in range(3))
                  + " from near group by id"),
}
