"""Tables written to the shared folder through the sinks and read back through the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import neighbours, quality, search, split
from kindred.plans import clustering, prediction
from kindred.plans.embedding import embed_observations, sentence_columns
from kindred.queries import trials
from kindred.queries.search import _COS, _REL
from kindred.queries.tables import E_SQL, OBS_SQL, observations, r6, vectors
from kindred.queries.text import _ngram_sql, _sentence_sql
from kindred.schemas import ADJUSTED_COLUMNS, OBSERVATION_COLUMNS
from kindred.session import scratch_path
from kindred.sources import logs
from kindred.sources import observations as obs_source
from kindred.sources import vectors as vec_source

DIM = 64
NO_CLUSTER = 200


def observations_csv(spark, folder):
    path = scratch_path(spark, "observations")
    obs_source.write_csv(observations(spark, folder).select("idx_global", *OBSERVATION_COLUMNS), path)
    return obs_source.read_observations(spark, path)


def unnumbered_csv(spark, folder):
    """Observations written in order without their id, numbered again by file and place."""
    path = scratch_path(spark, "unnumbered")
    obs_source.write_csv(observations(spark, folder).orderBy("idx_global").select(*OBSERVATION_COLUMNS), path)
    return obs_source.read_unnumbered(spark, path)


def _wide(df, *keep):
    return df.select(*keep, *[r6(F.col("embedding")[i].cast("double")).alias(str(i)) for i in range(DIM)])


def labelled_csv(spark, folder):
    path = scratch_path(spark, "wide")
    obs_source.write_csv(vec_source.to_wide(vectors(spark, folder).select("idx_global", "embedding", "label"), DIM,
                                            ["idx_global"]), path)
    return _wide(vec_source.read_wide_csv(spark, path, DIM, ["idx_global"]), "idx_global", "label")


def model_folders(spark, folder):
    """Vectors of two models in folders of their own."""
    path, e = scratch_path(spark, "models"), vectors(spark, folder).select("idx_global", "embedding")
    for model in ("st1", "st2"):
        vec_source.write_vectors(e, path, model)
    return _wide(vec_source.read_vectors(spark, path), "model", "idx_global")


def label_folders(spark, folder):
    """Original and reduced vectors of every cluster, from folders by label."""
    path, e = scratch_path(spark, "clusters"), vectors(spark, folder)
    clusters = e.select("idx_global", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("coords"),
                        F.col("cl").alias("label"), F.lit(1.0).alias("prob"))
    clustering.write_clusters(e.select("idx_global", "embedding"), clusters, path, 2)
    made = []
    for space in ("original", "reduced"):
        rows = vec_source.read_vectors(spark, f"{path}/{space}")
        made.append(rows.select(F.lit(space).alias("space"), "idx_global", F.col("label").cast("int").alias("label"),
                                F.size("embedding").alias("dim"), r6(F.col("embedding")[0].cast("double")).alias("x0"),
                                r6(F.element_at("embedding", -1).cast("double")).alias("x_last")))
    return made[0].unionByName(made[1])


def embedding_log(spark, folder):
    """The embedding log of all observations, exported with its vectors as text and read back."""
    path = scratch_path(spark, "embedding-log")
    cells = sentence_columns(True)
    made = embed_observations(observations(spark, folder), cells).withColumn("predicted", F.col("region").cast("int"))
    logs.append_embeddings(made, path, cells)
    text = logs.export_vector_text(spark.read.parquet(path))
    back = text.withColumn("embedding", F.from_json("embedding", "array<float>"))
    return _wide(back, "vector_input", "query_string", "predicted_label")


def hits_table(spark, folder):
    """Ten most similar rows of every vector with their source rows, by the hits table."""
    path, e = scratch_path(spark, "hits"), vectors(spark, folder)
    asked = e.select(F.col("idx_global").alias("query_id"), "label", "embedding")
    hits = neighbours.group_topk(asked, e, 10).withColumn("exact", F.lit(False))
    logs.append_hits(prediction.hydrate(hits, observations(spark, folder)), path)
    return spark.read.parquet(path).drop("timestamp").withColumn("similitud_coseno", r6("similitud_coseno"))


def undefined_quality(spark, folder):
    """Quality of labellings it is undefined for: every label as the only cluster, and nothing but noise."""
    e = vectors(spark, folder).select("idx_global", "embedding", "label")
    rows = e.withColumn("run", F.col("label")).unionByName(
        e.withColumn("run", F.lit(NO_CLUSTER)).withColumn("label", F.lit(-1)))
    valid = quality.dbcv(rows, by="run").select("g", "dbcv_score")
    return quality.silhouette(rows, by="run").join(valid, "g", "left").select(
        "g", "n_clusters", r6("noise_ratio").alias("noise_ratio"), "silhouette", "score", "dbcv_score")


def grid_cells(spark, folder):
    """Mean, deviation and rank of the noise share of every grid cell over three folds."""
    folds = split.kfold(vectors(spark, folder).select("idx_global"), 3)
    scores = trials.points(spark, folder).join(folds, "idx_global").groupBy("run_id", "fold").agg(
        F.avg((F.col("label") == -1).cast("double")).alias("score"))
    # Means equal to six digits tie.
    cells = search.cell_summary(scores, ["run_id"]).withColumn("mean_score", r6("mean_score")).drop("rank_score")
    return search.trial_rank(cells, "mean_score").select(
        "run_id", "mean_score", r6("std_score").alias("std_score"), "rank_score")


def search_results(spark, folder):
    """The best trial of every method in the result table, written by method and read back together."""
    path = scratch_path(spark, "results")
    for method, table in trials.methods(spark, folder).items():
        best = search.best_trial(table.withColumn("cost", F.round("cost", 6)), "cost")
        logs.write_search(path, search.result_row(best.withColumn("noise_ratio", r6("noise_ratio")), method, "st1"), table)
    return search.consolidated([spark.read.parquet(f"{path}/results").drop("timestamp")])


_X = ", ".join(f"round({{0}}[{i + 1}]::double, 6) + 0.0 as \"{i}\"" for i in range(DIM))
_COLS = ", ".join(OBSERVATION_COLUMNS)
_JSON = "'[\"' || " + " || '\",\"' || ".join(ADJUSTED_COLUMNS) + " || '\"]'"

QUERIES = {
    "observations_csv": (observations_csv, f"with {OBS_SQL} select idx_global, {_COLS} from obs"),
    "unnumbered_csv": (unnumbered_csv, f"with {OBS_SQL} select row_number() over (order by idx_global) - 1 as idx_global, {_COLS} from obs"),
    "labelled_csv": (labelled_csv, f"select vec_id as idx_global, label::int as label, {_X.format('embedding')} from embeddings"),
    "model_folders": (model_folders, f"select m as model, vec_id as idx_global, {_X.format('embedding')} from embeddings "
                      "cross join (values ('st1'), ('st2')) t(m)"),
    "label_folders": (label_folders, f"with {E_SQL} select space, id as idx_global, cl as label, n as dim, round(v[1], 6) + 0.0 as x0, "
                      f"round(v[n], 6) + 0.0 as x_last from e cross join (values ('original', {DIM}), ('reduced', 2)) t(space, n)"),
    "embedding_log": (embedding_log, f"with {OBS_SQL}, sent as (select idx_global, {_JSON} as cells, region::int as region, "
                      f"{_sentence_sql(ADJUSTED_COLUMNS)} as s from obs), {_ngram_sql('sent', 'idx_global', 's')}, "
                      "w as (select k, bucket, round((c / l)::float::double, 6) + 0.0 as x from grams join lens using (k)) "
                      "select cells as vector_input, s as query_string, region as predicted_label, "
                      + ", ".join(f"coalesce(max(x) filter (where bucket = {i}), 0.0) as \"{i}\"" for i in range(DIM))
                      + " from sent join w on k = idx_global group by idx_global, cells, s, region"),
    "hits_table": (hits_table, f"with {E_SQL}, {_REL}, {OBS_SQL}, h as (select a.id as query_id, row_number() over (partition by a.id "
                   f"order by {_COS.format('a.v', 'b.v')} desc, b.id) as rank, b.id as hit, "
                   f"round({_COS.format('a.v', 'b.v')}, 6) + 0.0 as similitud_coseno from e a join e b on a.label = b.label qualify rank <= 10) "
                   f"select query_id, rank, similitud_coseno, r as indice_relativo, hit as indice_global, {_COLS}, case when idx_global "
                   f"is not null then {_sentence_sql(ADJUSTED_COLUMNS, False)} end as sentencia_procesada "
                   "from h join rel on rel.id = hit left join obs on idx_global = hit"),
    "undefined_quality": (undefined_quality, f"with {E_SQL}, g as (select label as g, 1 as c, 0.0::double as noise from e group by label "
                          f"union all select {NO_CLUSTER}, 0, 1.0) select g::bigint as g, c::bigint as n_clusters, noise as noise_ratio, "
                          "null::double as silhouette, -1.0::double as score, null::double as dbcv_score from g"),
    "grid_cells": (grid_cells, f"with {trials._T}, f as (select id, (row_number() over (order by id) - 1) * 3 // count(*) over () as fold from e), "
                   "s as (select run_id, fold, avg((l = -1)::int) as x from pts join f using (id) group by all), "
                   "c as (select run_id::bigint as run_id, round(avg(x), 6) + 0.0 as mean_score, round(stddev_pop(x), 6) + 0.0 as std_score "
                   "from s group by run_id) select *, rank() over (order by mean_score desc) as rank_score from c"),
    "search_results": (search_results, f"with {trials._T}, {trials._M} select method, null::int as n_neighbors, null::int as n_components, "
                       "null::int as min_cluster_size, min_samples::int as min_samples, null::double as min_dist, me.n_clusters::int as n_clusters, "
                       "round(noise_ratio, 6) + 0.0 as noise_ratio, dbcv_score, 'st1' as model from me join tl using (run_id) "
                       "qualify row_number() over (partition by method order by round(cost, 6), run_id) = 1"),
}
