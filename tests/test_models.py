import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import classify, kernel, search, split
from kindred.plans import clustering, prediction
from kindred.plans.embedding import embed_observations
from kindred.schemas import OBSERVATION_COLUMNS, OBSERVATIONS
from kindred.sources import logs, registry


@pytest.fixture(scope="module")
def labelled(spark, blobs):
    x, truth = blobs
    rows = [(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, truth))]
    return spark.createDataFrame(rows, "idx_global long, embedding array<float>, label int").where("label >= 0")


@pytest.mark.parametrize("kind", ["random_forest", "svm", "mlp"])
def test_classifier_learns_blobs_and_survives_saving(spark, labelled, kind, tmp_path):
    models = classify.train(labelled, [kind])
    paths = classify.save_models(models, str(tmp_path), "_adjusted")
    assert paths[kind].endswith(f"classifier_{kind}_adjusted")
    got = classify.predict(classify.load_model(paths[kind]), labelled).toPandas()
    assert (got.predicted == got.label).mean() >= 0.99
    for probs in got.probabilities:
        values = [p["probability"] for p in probs]
        assert abs(sum(values) - 1) < 1e-6 and values == sorted(values, reverse=True)
    assert (got.confidence == [p[0]["probability"] for p in got.probabilities]).all()


def test_kernel_machine_reaches_the_optimum_of_every_problem(spark, labelled):
    rows = classify.with_features(split.kfold(labelled.where("label < 3"), 2)).select(
        "features", F.col("label").alias("label_index"), "fold")
    machine, scores = kernel.fit(rows, 2, 3, 8, 1e-4, 7, size=32, rounds=200, tolerance=1e-10)
    data = rows.toPandas()
    x = kernel.lift(np.stack([v.toArray() for v in data.features]), *kernel.basis(8, 32, 1e-4, 7))

    def newton(x, y):
        w = np.zeros(x.shape[1])
        for _ in range(100):
            gap = np.maximum(0, 1 - y * (x @ w))
            near = x[gap > 0]
            slope = w - 2 * x.T @ (gap * y)
            step, size = np.linalg.solve(np.eye(len(w)) + 2 * near.T @ near, slope), 1.0
            cost = lambda v: v @ v / 2 + (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
            while cost(w - size * step) > cost(w) and size > 1e-9:
                size /= 2
            w = w - size * step
        return w

    def solved(keep):
        return np.stack([newton(x[keep], np.where(data.label_index[keep] == c, 1.0, -1.0)) for c in range(3)])

    whole = solved(np.full(len(data), True))
    assert np.abs(np.array(machine.getOrDefault(machine.weights)).reshape(3, -1) - whole).max() < 1e-4
    for f in range(2):
        held = (data.fold == f).to_numpy()
        assert scores[f] == ((x[held] @ solved(~held).T).argmax(axis=1) == data.label_index[held]).mean()


def test_kernel_machine_on_an_empty_fold_and_copies(labelled):
    one = labelled.withColumn("embedding", F.when(F.col("label") == 0, F.array(*[F.lit(1.0).cast("float")] * 8)).otherwise(F.col("embedding")))
    rows = classify.with_features(one).select("features", F.col("label").alias("label_index"), F.lit(0).alias("fold"))
    machine, scores = kernel.fit(rows, 2, 5, 8, 1e-4, 7)
    assert scores[1] == 0 and np.isfinite(machine.getOrDefault(machine.weights)).all()
    assert machine.transform(rows).where("prediction = label_index").count() > 0.95 * rows.count()


def test_noise_is_a_class_of_its_own(spark, labelled):
    noisy = labelled.withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    got = classify.predict(classify.train(noisy, ["random_forest"])["random_forest"], noisy)
    assert -1 in {r.predicted for r in got.select("predicted").distinct().collect()}


def test_cross_validation_picks_the_best_mean(labelled):
    shuffled = labelled.withColumn("idx_global", F.abs(F.xxhash64("idx_global")) % 1000003)
    scores, best, model = classify.cross_validate(shuffled, ["random_forest"])
    row = scores.first()
    assert best == "random_forest" and row.cv_mean > 0.95 and row.cv_std >= 0
    accuracy, report = classify.evaluate(model, labelled)
    assert accuracy.first().accuracy > 0.95 and report.count() == 7
    assert row.accuracy == accuracy.first().accuracy and 0.9 < row.r1 <= 1 and len(row.cv_scores) == 3


def test_highest_mean_of_the_folds_wins_and_is_saved(spark, labelled, monkeypatch, tmp_path):
    given = {"RandomForestClassifier": [0.5, 0.7, 0.6], "MultilayerPerceptronClassifier": [0.9, 0.4, 0.8]}
    monkeypatch.setattr(classify, "_fold_scores", lambda estimator, rows, folds: given[type(estimator).__name__])
    for _ in range(2):
        scores, best, model = classify.cross_validate(labelled, ["random_forest", "mlp"])
        classify.save_results(scores, best, str(tmp_path), "st1")
    assert best == "mlp" and classify.evaluate(model, labelled)[0].first().accuracy > 0.9
    rows = spark.read.parquet(str(tmp_path / "train_results")).collect()
    assert len(rows) == 4 and {r.classifier_model: r.cv_scores for r in rows} == {
        "random_forest": [0.5, 0.7, 0.6], "mlp": [0.9, 0.4, 0.8]}
    info = spark.read.parquet(str(tmp_path / "classification_info")).collect()
    assert [(r.best_model, round(r.best_score, 6), r.random_state) for r in info] == [("mlp", 0.7, 42)]


def test_grid_size_and_table(spark):
    assert search.grid_size(search.ADJUSTED_REDUCTION_SPACE) == 60
    assert search.grid_size(search.ADJUSTED_DENSITY_SPACE) == 100
    assert search.grid_size(search.ORIGINAL_REDUCTION_SPACE) == 30
    assert search.grid_size(search.ORIGINAL_DENSITY_SPACE, folds=3) == 48
    cells = search.grid_table(spark, search.ORIGINAL_DENSITY_SPACE).collect()
    assert sorted(r.cell_id for r in cells) == list(range(16))


def test_proposals_prefer_values_of_good_trials(spark):
    trials = spark.createDataFrame(
        [(i, 5 if i < 3 else 9, 0.1 * i) for i in range(8)], "run_id long, min_samples int, loss double")
    got = {r.value: r for r in search.propose(trials, {"min_samples": [5, 9]}).collect()}
    assert got[5.0].choice and not got[9.0].choice and got[5.0].good == 2


def test_random_search_best_is_the_minimum_and_repeats(labelled):
    space = {"n_neighbors": [8, 12], "n_components": [2], "min_cluster_size": [10, 30], "min_samples": [4]}
    trials, best, labels = search.random_search(labelled, space, 3, iterations=4)
    rows = trials.collect()
    assert [r.cost for r in rows] == sorted(r.cost for r in rows)
    assert best["cost"] == rows[0].cost and rows[0].dbcv_score == best["dbcv_score"]
    n = labels.count()
    low = labels.where("prob < 0.05").count()
    assert low / n == pytest.approx(best["cost"])


def test_a_trial_costs_the_same_alone_and_in_any_batch(labelled):
    trial = {"run_id": 0, "n_neighbors": 8, "n_components": 2, "min_cluster_size": 10, "min_samples": 4, "min_dist": 0.0}
    others = [{**trial, "run_id": 1, "min_samples": 30}, {**trial, "run_id": 2, "n_neighbors": 12, "n_components": 3}]
    alone = search.evaluate_trials(labelled, [trial])[0].first()
    batch = search.evaluate_trials(labelled, [trial, *others])[0].where("run_id = 0").first()
    again = clustering.score_clusters(clustering.generate_clusters(labelled, 8, 2, 10, 4)).first()
    assert alone.cost == batch.cost == pytest.approx(again.cost)
    assert alone.label_count == batch.label_count == again.label_count


def test_generate_clusters_and_write(spark, labelled, tmp_path):
    out = clustering.generate_clusters(labelled, 10, 2, 10, 5)
    score = clustering.score_clusters(out).first()
    assert score.n_points == labelled.count() and score.n_clusters >= 3
    clustering.write_clusters(labelled.drop("label"), out, str(tmp_path), 2)
    back = spark.read.parquet(f"{tmp_path}/original").where("label = 0")
    assert "PartitionFilters: [isnotnull(label" in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == out.where("label = 0").count()


@pytest.fixture(scope="module")
def observed(spark):
    rows = [(i, f"place {i % 4}", str(2000 + i % 6), f"topic.{i % 3}", "1k", float(i)) for i in range(48)]
    return spark.createDataFrame(rows, OBSERVATIONS)


def test_rows_are_found_by_their_own_sentence(spark, observed):
    corpus = embed_observations(observed).select(
        "idx_global", "embedding", F.substring("spatial", 7, 1).cast("int").alias("label"))
    model = classify.train(corpus, ["random_forest"])["random_forest"]
    queries = observed.withColumnRenamed("idx_global", "query_id")
    unknown = queries.where("query_id < 2").select(
        (F.col("query_id") + 1000).alias("query_id"), "spatial", F.lit("1950").alias("temporal"),
        "interest", "reference", "observation")
    predictions, hits = prediction.predict_batch(queries.unionByName(unknown), corpus, observed, model)
    p = {r.query_id: r for r in predictions.collect()}
    # Equal sentences repeat every 12 rows; the first one is the hit.
    assert all(p[i].found and p[i].idx_global == i % 12 for i in range(48))
    assert not p[1000].found and not p[1001].found
    shown = hits.where("query_id = 1000").orderBy("rank").collect()
    sims = [r.similarity for r in shown]
    assert len(sims) == 10 and sims == sorted(sims, reverse=True) and not any(r.exact for r in shown)
    exact = hits.where("query_id = 13").first()
    assert exact.exact and exact.in_range and exact.sentence_shown == "place_1_2001_topic.1"


def test_noise_queries_search_everything(spark, vectors):
    corpus = vectors([[1, 0], [0, 1], [1, 1]], labels=[0, 1, 1])
    asked = spark.createDataFrame([(5, -1, 0.9, [1.0, 0.9])], "query_id long, predicted int, confidence double, embedding array<float>")
    _, hits = prediction.search_predicted(asked, corpus)
    assert [(r.label, r.idx_relativo, r.idx_global) for r in hits.orderBy("rank").collect()] == \
        [(1, 1, 2), (0, 0, 0), (1, 0, 1)]


def test_hits_outside_the_source_are_marked(spark, observed):
    hits = spark.createDataFrame([(1, 3, False), (1, 999, False)], "query_id long, idx_global long, exact boolean")
    got = {r.idx_global: r for r in prediction.hydrate(hits, observed, adjusted=False).collect()}
    assert got[3].in_range and got[3].sentence_shown == "place 3 2003 topic.0 1k 3.0"
    assert not got[999].in_range and got[999].sentence_shown is None


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    for adjusted in (True, False):
        registry.register(spark, path, model="st1", classifier="mlp", use_adjusted=adjusted, params="separate_grid",
                          observations_path="o", embeddings_path="e", model_path="m")
    listed = registry.list_models(spark, path)
    assert "model_path" not in listed.columns
    assert {r.model_key for r in listed.collect()} == {"st1_mlp", "st1_mlp_adjusted"}
    known = spark.read.parquet(path)
    asked = spark.createDataFrame([("st1_mlp",)], "model_key string")
    assert registry.lookup(asked, known).first().params == "gridSearch"
    registry.register(spark, path, model="st1", classifier="mlp", use_adjusted=False, params="random",
                      observations_path="o", embeddings_path="e", model_path="new")
    again = registry.lookup(asked, spark.read.parquet(path)).collect()
    assert [r.model_path for r in again] == ["new"]
    assert registry.list_models(spark, path).count() == 2
    bad = spark.createDataFrame([("st9_mlp",)], "model_key string")
    with pytest.raises(Exception, match="classifier not loaded: st9_mlp"):
        registry.lookup(bad, known).collect()


def test_prediction_log_counts_on(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = spark.createDataFrame([(7, "s", 1, 0.5, True), (3, "t", -1, 0.4, False)],
                                  "query_id long, sentence string, predicted int, confidence double, found boolean")
    logs.append_predictions(batch, path)
    logs.append_predictions(batch, path)
    got = logs.read_log(spark, path).orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 3, 4] and [r.query_original for r in got] == ["t", "s", "t", "s"]
    logs.append_timing(spark, str(tmp_path / "times"), "random_search", 1.239)
    assert spark.read.parquet(str(tmp_path / "times")).first().tiempo_segundos == 1.24


def test_observation_columns_are_the_sentence():
    assert OBSERVATION_COLUMNS[:3] == ["spatial", "temporal", "interest"]


def test_embedding_log_hits_and_timings(spark, observed, tmp_path):
    made = embed_observations(observed.limit(2), OBSERVATION_COLUMNS).withColumn("predicted", F.lit(4)).withColumn(
        "reference", F.lit(None).cast("string"))
    logs.append_embeddings(made, str(tmp_path / "vectors"), ["spatial", "reference"])
    logs.append_embeddings(made, str(tmp_path / "vectors"))
    rows = spark.read.parquet(str(tmp_path / "vectors"))
    assert rows.columns == ["vector_input", "query_string", "embedding", "predicted_label", "timestamp"]
    assert {r.vector_input for r in rows.collect()} == {None} | {
        f'["{r.spatial}",null]' for r in made.collect()}
    text = logs.export_vector_text(rows).withColumn("back", F.from_json("embedding", "array<float>"))
    assert sorted(map(str, text.select("back").collect())) == sorted(
        str(r).replace("embedding", "back") for r in rows.select("embedding").collect())
    hits = spark.createDataFrame([(1, 1, 0, 3, 0.5, False), (1, 2, 9, 999, 0.25, False)],
                                 "query_id long, rank long, idx_relativo long, idx_global long, similarity double, exact boolean")
    for _ in range(2):
        logs.append_hits(prediction.hydrate(hits, observed), str(tmp_path / "hits"))
    kept = spark.read.parquet(str(tmp_path / "hits"))
    assert kept.count() == 4
    got = {r.indice_global: r for r in kept.collect()}
    assert got[3].similitud_coseno == 0.5 and got[3].sentencia_procesada.startswith("place 3")
    assert got[999].spatial is None and got[999].sentencia_procesada is None
    logs.append_embedding_timings(spark, str(tmp_path / "times"), "st1", {"load": 1.239, "save": 2.0})
    row = spark.read.parquet(str(tmp_path / "times")).first()
    assert (row.modelo, row.tiempo_carga_dataset, row.tiempo_guardado_embeddings, row.tiempo_carga_modelo) == ("st1", 1.24, 2.0, None)


def test_result_row_and_cells(spark):
    best = spark.createDataFrame([(7, 5, 0.25, 3, None)], "run_id long, min_samples int, noise_ratio double, n_clusters long, dbcv_score double")
    row = search.result_row(best, "random_search", "st1").first()
    assert len(row) == 11 and (row.method, row.min_samples, row.min_dist, row.n_clusters, row.dbcv_score) == ("random_search", 5, None, 3, None)
    scores = spark.createDataFrame([(0, 0.5), (0, 1.0), (1, 0.75), (1, 0.75), (2, 0.1)], "cell_id long, score double")
    got = {r.cell_id: (r.mean_score, r.std_score, r.rank_score) for r in search.cell_summary(scores, ["cell_id"]).collect()}
    assert got == {0: (0.75, 0.25, 1), 1: (0.75, 0.0, 1), 2: (0.1, 0.0, 3)}


def test_training_rows_are_held_in_no_more_parts_than_cores(spark):
    """Every part of a forest's rows sends the statistics of all nodes of a level, so 200 small parts took most of the time."""
    rows = spark.range(5000).withColumn("fold", F.col("id") % 3).repartition(64)
    held = classify._training_rows(rows)
    assert held.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert held.count() == 5000 and held.agg(F.sum("id")).first()[0] == 5000 * 4999 // 2
    held.unpersist()
