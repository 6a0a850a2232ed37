"""Scans, samples, positions, joins by id, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import naming
from kindred.operators import ranks, split
from kindred.queries.tables import E_SQL, OBS_SQL, load, observations, vectors
from kindred.schemas import OBSERVATION_COLUMNS
from kindred.sources import logs, registry
from kindred.sources import observations as obs_source
from kindred.sources import vectors as vec_source

DIM = 64
SEED = "42"


def first_n(spark, folder):
    return obs_source.first_rows(observations(spark, folder), 100).select("idx_global", *OBSERVATION_COLUMNS)


def sample_exact(spark, folder):
    return obs_source.sample_rows(observations(spark, folder), 0.01, seed=SEED).select(
        "idx_global", *OBSERVATION_COLUMNS)


def wide_roundtrip(spark, folder):
    e = vectors(spark, folder).select("idx_global", "embedding", "label")
    wide = vec_source.to_wide(e, DIM, ["idx_global"])
    back = vec_source.from_wide(wide, ["idx_global"])
    return vec_source.to_wide(back, DIM, ["idx_global"]).select(
        "idx_global", "label", *[F.col(f"`{i}`").cast("double").alias(str(i)) for i in range(DIM)])


def complete_docs(spark, folder):
    """Source columns of the documents beside the vectors of the same id."""
    docs = load(spark, folder, "documents").select(F.col("doc_id").alias("idx_global"), "lang", "n_chars")
    e = vectors(spark, folder).select("idx_global", "embedding")
    joined = obs_source.add_columns(e, docs, ["lang", "n_chars"])
    return joined.select("idx_global", "lang", "n_chars",
                         *[F.col("embedding")[i].cast("double").alias(str(i)) for i in range(DIM)])


def aligned_labels(spark, folder):
    """Vectors with the labels of a separate table, joined by id."""
    e = vectors(spark, folder).select("idx_global", "embedding")
    quality = load(spark, folder, "labels").select(
        F.col("doc_id").alias("idx_global"), F.col("quality").cast("int").alias("label"))
    joined = vec_source.align_labels(e, quality)
    return joined.select("idx_global", "label", F.col("embedding")[0].cast("double").alias("x0"))


def group_rows(spark, folder):
    """All rows of the largest group (ties to the lower label)."""
    e = vectors(spark, folder)
    sizes = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    return e.join(largest, "label").select("idx_global", "label", F.col("embedding")[0].cast("double").alias("x0"))


def group_index(spark, folder):
    e = vectors(spark, folder).select("label", "idx_global")
    return ranks.relative_index(e, ["label"]).select("label", "idx_global", "idx_relativo")


def fetch_rows(spark, folder):
    """Source rows by id with a flag for ids outside the table."""
    ids = load(spark, folder, "events").select(F.col("event_id").alias("idx_global"), "user_id")
    docs = load(spark, folder, "documents").select(F.col("doc_id").alias("idx_global"), "lang", "n_chars")
    return obs_source.fetch_rows(ids, docs).select("idx_global", "user_id", "lang", "n_chars", "found")


def stratified_split(spark, folder):
    e = vectors(spark, folder).select("idx_global", F.col("cl").alias("label"))
    return split.stratified_split(e, 0.2, True, SEED).select("idx_global", "label", "is_test")


def kfold(spark, folder):
    return split.kfold(vectors(spark, folder).select("idx_global"), 3).select("idx_global", "fold")


def log_append(spark, folder):
    """The event log with the vectors' rows appended; columns either side lacks are NULL."""
    old = load(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    new = vectors(spark, folder).select(F.col("idx_global").alias("id"), F.lit("vector").alias("kind"),
                                        F.col("label").alias("grupo_predicho"))
    return logs.log_union(old, new)


def log_next_id(spark, folder):
    """New rows numbered upwards from the highest id of the log."""
    last = load(spark, folder, "events").agg(F.max("event_id").alias("last_id"))
    batch = vectors(spark, folder).select(F.col("idx_global").alias("query_id"), "label")
    return logs.next_ids(batch, last, "query_id").select("query_id", "label", "id")


def prediction_json(spark, folder):
    e = vectors(spark, folder)
    return e.select("idx_global", naming.prediction_json(F.col("cl"), F.lit("st1"), F.lit("mlp")).alias("response"))


def _keyed(spark, folder):
    o = observations(spark, folder)
    return o.select("idx_global", naming.model_key(
        F.col("reference"), F.col("spatial"), F.col("observation") > 250000).alias("model_key"))


def model_lookup(spark, folder):
    """Every observation with the registry row of its key; every customer registers the keys of its segment and
    country again, the one of the highest number last."""
    c = load(spark, folder, "customer").join(
        load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    known = c.select("c_name", F.timestamp_seconds("c_custkey").alias("registered_at"), F.explode(F.array(*[
        naming.model_key(F.col("c_mktsegment"), F.col("n_name"), F.lit(adjusted)) for adjusted in (False, True)])).alias("model_key"))
    return registry.lookup(_keyed(spark, folder), known.withColumnRenamed("c_name", "model_path")).select(
        "idx_global", "model_key", "model_path")


_WIDE = ", ".join(f"embedding[{i + 1}]::double as \"{i}\"" for i in range(DIM))
_COLS = ", ".join(OBSERVATION_COLUMNS)
_KEY = "reference || '_' || spatial || case when observation > 250000 then '_adjusted' else '' end"

QUERIES = {
    "first_n": (first_n, f"with {OBS_SQL} select idx_global, {_COLS} from obs order by idx_global limit 100"),
    "sample_exact": (sample_exact, f"with {OBS_SQL} select idx_global, {_COLS} from obs "
                     f"order by md5('{SEED}' || cast(idx_global as varchar)), idx_global "
                     "limit (select round(0.01 * count(*))::bigint from obs)"),
    "wide_roundtrip": (wide_roundtrip, f"select vec_id as idx_global, label::int as label, {_WIDE} from embeddings"),
    "complete_docs": (complete_docs, f"select doc_id as idx_global, lang, n_chars, {_WIDE} "
                      "from documents join embeddings on doc_id = vec_id"),
    "aligned_labels": (aligned_labels, "select vec_id as idx_global, quality::int as label, "
                       "embedding[1]::double as x0 from embeddings join labels on vec_id = doc_id"),
    "group_rows": (group_rows, f"with {E_SQL} select id as idx_global, label, v[1] as x0 from e where label = "
                   "(select label from e group by label order by count(*) desc, label limit 1)"),
    "group_index": (group_index, f"with {E_SQL} select label, id as idx_global, "
                    "row_number() over (partition by label order by id) - 1 as idx_relativo from e"),
    "fetch_rows": (fetch_rows, "select event_id as idx_global, user_id, lang, n_chars, doc_id is not null as found "
                   "from events left join documents on doc_id = event_id"),
    "stratified_split": (stratified_split, f"with {E_SQL}, k as (select id, cl, row_number() over (partition by cl "
                         f"order by md5('{SEED}' || cast(id as varchar)), id) - 1 as p, count(*) over (partition by cl) as n "
                         "from e where cl <> -1) select id as idx_global, cl as label, p < floor(n * 0.2 + 0.5) as is_test from k"),
    "kfold": (kfold, f"with {E_SQL} select id as idx_global, ((row_number() over (order by id) - 1) * 3 // "
              "count(*) over ())::int as fold from e"),
    "log_append": (log_append, "select event_id as id, event_type as kind, value, cast(null as int) as grupo_predicho "
                   "from events union all select vec_id, 'vector', cast(null as double), label::int from embeddings"),
    "log_next_id": (log_next_id, "select vec_id as query_id, label::int as label, (select max(event_id) from events) + "
                    "row_number() over (order by vec_id) as id from embeddings"),
    "prediction_json": (prediction_json, f"with {E_SQL} select id as idx_global, '{{\"grupo_predicho\":' || cl || "
                        "',\"modelo\":\"st1\",\"clasificador\":\"mlp\"}' as response from e"),
    "model_lookup": (model_lookup, f"with {OBS_SQL}, k as (select idx_global, {_KEY} as model_key, spatial, reference from obs), "
                     "r as (select n_name, c_mktsegment, max_by(c_name, c_custkey) as model_path from customer "
                     "join nation on c_nationkey = n_nationkey group by all) "
                     "select idx_global, model_key, model_path from k join r on spatial = n_name and reference = c_mktsegment"),
}
