"""Classifiers, reduction, clustering, parameter search, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import classify, density, heldout, neighbours, reduce, search
from kindred.plans import clustering, prediction
from kindred.plans.embedding import embed_observations
from kindred.queries.search import _COS, _MOVED, _other_side
from kindred.queries.tables import E_SQL, observations, r6, vectors
from kindred.session import cut, scratch_path
from kindred.streaming import scoring

SEARCH_SPACE = {
    "n_neighbors": [10, 15],
    "n_components": [2, 3],
    "min_cluster_size": [5, 10],
    "min_samples": [5, 8],
    "min_dist": [0.0, 0.1],
}


def _classified(spark, folder, kind):
    e = vectors(spark, folder).select("idx_global", "embedding", F.col("cl").alias("label"))
    model = classify.train(e, [kind])[kind]
    return classify.predict(model, e).select("idx_global", "label", "predicted", r6("confidence").alias("confidence"))


def rf_predict(spark, folder):
    return _classified(spark, folder, "random_forest")


def mlp_predict(spark, folder):
    return _classified(spark, folder, "mlp")


def svm_predict(spark, folder):
    return _classified(spark, folder, "svm")


def cross_validate(spark, folder):
    scores, _, _ = classify.cross_validate(vectors(spark, folder))
    return _scores(scores)


def _scores(scores):
    return scores.select("classifier", *[r6(c).alias(c) for c in ("r1", "accuracy", "cv_mean", "cv_std")])


def train_observations(spark, folder):
    """All observations, encoded, as training rows of their place: all classifiers over three folds."""
    o = cut(embed_observations(observations(spark, folder)).select("idx_global", "embedding", "spatial"), "training")
    return _scores(classify.cross_validate(o, label="spatial")[0])


def fuzzy_edges(spark, folder):
    """Symmetric weights of the cosine graph that layouts are made of, each pair once."""
    graph = neighbours.knn_graph(vectors(spark, folder), 15, "cosine")
    return reduce.fuzzy_edges(graph, [15], "idx_global").where("a < b").select("a", "b", r6("w").alias("w"))


def predict_batch(spark, folder):
    """All observations as queries against themselves: sentence, vector, group, exact hit or similar rows."""
    o = observations(spark, folder)
    corpus = cut(embed_observations(o).select(
        "idx_global", "embedding", F.col("region").cast("int").alias("label")), "corpus")
    model = classify.train(corpus, ["random_forest"])["random_forest"]
    queries = o.withColumnRenamed("idx_global", "query_id").drop("region")
    _, hits = prediction.predict_batch(queries, corpus, o.drop("region"), model)
    return hits.select("query_id", "label", "exact", "rank", "idx_relativo", "idx_global",
                       r6("similarity").alias("similarity"), "in_range", "sentence_shown")


def reduce_layout(spark, folder):
    out = reduce.reduce_layout(vectors(spark, folder), 15, 3)
    return out.select("idx_global", *[r6(F.col("coords")[i]).alias(f"c{i}") for i in range(3)])


def pca_layout(spark, folder):
    out = reduce.pca_layout(vectors(spark, folder), 2)
    return out.select("idx_global", *[r6(F.col("coords")[i]).alias(f"c{i}") for i in range(2)])


def density_cluster(spark, folder):
    out = density.density_cluster(vectors(spark, folder), 5, 5)
    return out.select("idx_global", "label", r6("prob").alias("prob"))


def generate_clusters(spark, folder):
    out = clustering.generate_clusters(vectors(spark, folder), 15, 2, 5, 5)
    return out.select("idx_global", "label", r6("prob").alias("prob"))


def random_search(spark, folder):
    trials, _, _ = search.random_search(vectors(spark, folder), SEARCH_SPACE, 6)
    return trials


def bayes_search(spark, folder):
    trials, _, _ = search.bayesian_search(vectors(spark, folder), SEARCH_SPACE, 2, 10, 6, 3)
    return trials


def grid_search(spark, folder):
    summary, _, _, _, _ = search.separate_grid_search(
        vectors(spark, folder),
        {k: SEARCH_SPACE[k] for k in ("n_neighbors", "n_components", "min_dist")},
        {k: SEARCH_SPACE[k] for k in ("min_cluster_size", "min_samples")})
    return summary


def heldout_cells(spark, folder):
    """Reduction cells fitted on two folds and scored on the third: mean, deviation and rank of every cell."""
    space = {k: SEARCH_SPACE[k] for k in ("n_neighbors", "n_components", "min_dist")}
    scores = heldout.reduction_scores(vectors(spark, folder), space, search.grid_table(spark, space))
    return search.cell_summary(scores, ["cell_id", *space]).select(
        "cell_id", *space, r6("mean_score").alias("mean_score"), r6("std_score").alias("std_score"), "rank_score")


def stream_scores(spark, folder):
    """The nearest-label query run as a stream over the files of the table."""
    corpus = vectors(spark, folder)
    raw = spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet")
    stream = scoring.query_stream(spark, f"{folder.rstrip('/')}/embeddings.parquet*", raw.schema)

    def score(batch):
        asked = _other_side(batch.withColumnRenamed("vec_id", "idx_global"))
        hits = neighbours.global_topk(asked, corpus, 1)
        return hits.select("query_id", "idx_global", F.col("label").alias("predicted"),
                           r6("similarity").alias("similarity"))

    out = scratch_path(spark, "stream-out")
    scoring.score_stream(stream, score, out, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def stream_log(spark, folder):
    """Running log ids given to events arriving as a stream."""
    path = f"{folder.rstrip('/')}/events.parquet"
    raw = spark.read.parquet(path)
    stream = scoring.query_stream(spark, f"{path}*", raw.schema).select(
        F.col("event_id").alias("query_id"), "event_type", "value")
    out = scratch_path(spark, "log-out")
    scoring.log_stream(stream, out, scratch_path(spark, "log-state")).awaitTermination()
    return spark.read.parquet(out).select("query_id", "event_type", "value", "id")


QUERIES = {
    "rf_predict": (rf_predict, None),
    "mlp_predict": (mlp_predict, None),
    "svm_predict": (svm_predict, None),
    "cross_validate": (cross_validate, None),
    "train_observations": (train_observations, None),
    # Bandwidths by bisection, row by row, until the weights of a list add up to log2 of its length.
    "fuzzy_edges": (fuzzy_edges, f"with recursive {E_SQL}, near as (select a.id as id, b.id as nb, 1 - {_COS.format('a.v', 'b.v')} as d "
                    f"from e a join e b on a.id <> b.id qualify row_number() over (partition by a.id order by {_COS.format('a.v', 'b.v')} desc, b.id) <= 15), "
                    "gaps as materialized (select id, list(greatest(d - low, 0)) as g, max(d) as top from (select *, coalesce(min(d) filter (where d > 0) "
                    "over (partition by id), 0) as low from near) group by id), "
                    "half(id, i, lo, hi) as (select id, 0, 0.0::double, greatest(top, 1e-12) * 1e3 from gaps union all "
                    "select id, i + 1, case when wide then lo else (lo + hi) / 2 end, case when wide then (lo + hi) / 2 else hi end from "
                    "(select h.*, list_sum(list_transform(g, lambda x: exp(-x * 2 / (lo + hi)))) > log2(len(g)) as wide "
                    "from half h join gaps using (id) where i < 60)), "
                    "w as (select near.id as a, nb as b, exp(-greatest(d - low, 0) / hi) as w from (select *, coalesce(min(d) filter (where d > 0) "
                    "over (partition by id), 0) as low from near) near join half on half.id = near.id and i = 60) "
                    "select least(a, b) as a, greatest(a, b) as b, round(sum(w) - case when count(*) > 1 then max(w) * min(w) else 0 end, 6) + 0.0 as w "
                    "from w group by 1, 2"),
    "predict_batch": (predict_batch, None),
    "reduce_layout": (reduce_layout, None),
    "pca_layout": (pca_layout, None),
    "density_cluster": (density_cluster, None),
    "generate_clusters": (generate_clusters, None),
    "random_search": (random_search, None),
    "bayes_search": (bayes_search, None),
    "grid_search": (grid_search, None),
    "heldout_cells": (heldout_cells, None),
    "stream_scores": (stream_scores, f"with {E_SQL}, q as (select id, {_MOVED} as v from e) "
                      "select q.id as query_id, b.id as idx_global, b.label as predicted, "
                      f"round({_COS.format('q.v', 'b.v')}, 6) + 0.0 as similarity from q cross join e b "
                      f"qualify row_number() over (partition by q.id order by {_COS.format('q.v', 'b.v')} desc, b.id) = 1"),
    "stream_log": (stream_log, "select event_id as query_id, event_type, value, "
                   "row_number() over (order by event_id) as id from events"),
}
