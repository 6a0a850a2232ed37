"""Row types of the tables this library reads and writes."""

from pyspark.sql import types as T

OBSERVATION_COLUMNS = ["spatial", "temporal", "interest", "reference", "observation"]
ADJUSTED_COLUMNS = OBSERVATION_COLUMNS[:3]

OBSERVATIONS = T.StructType([
    T.StructField("idx_global", T.LongType()),
    T.StructField("spatial", T.StringType()),
    T.StructField("temporal", T.StringType()),
    T.StructField("interest", T.StringType()),
    T.StructField("reference", T.StringType()),
    T.StructField("observation", T.DoubleType()),
])

# Column names of the prediction log.
PREDICTION_LOG = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("query_original", T.StringType()),
    T.StructField("grupo_predicho", T.IntegerType()),
    T.StructField("confianza", T.DoubleType()),
    T.StructField("prediccion", T.BooleanType()),
    T.StructField("id", T.LongType()),
])

# Column names of the hits table, and the stages of an embedding run with their columns.
HIT_COLUMNS = {"similarity": "similitud_coseno", "idx_relativo": "indice_relativo", "idx_global": "indice_global"}
EMBEDDING_TIMINGS = {
    "load": "tiempo_carga_dataset",
    "text": "tiempo_procesado_texto",
    "model": "tiempo_carga_modelo",
    "embed": "tiempo_generacion_embeddings",
    "save": "tiempo_guardado_embeddings",
}

TRIALS_DDL = (
    "run_id long, n_neighbors int, n_components int, min_cluster_size int, min_samples int, "
    "min_dist double, label_count long, n_clusters long, noise_ratio double, cost double, "
    "dbcv_score double"
)

REGISTRY = T.StructType([
    T.StructField("model_key", T.StringType()),
    T.StructField("modelo_name", T.StringType()),
    T.StructField("classifier_type", T.StringType()),
    T.StructField("use_adjusted", T.BooleanType()),
    T.StructField("params", T.StringType()),
    T.StructField("originales_path", T.StringType()),
    T.StructField("embeddings_path", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("registered_at", T.TimestampType()),
])
