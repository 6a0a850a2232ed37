"""Clustering parameter search: grids, random draws, model-based proposals, ranking."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.operators import density, heldout, quality, reduce, tiles
from kindred.schemas import TRIALS_DDL
from kindred.session import cut, small_table

# Default search spaces and the penalty for a cluster count out of range.
DEFAULT_REDUCTION_SPACE = {
    "n_neighbors": [5, 10, 15, 20, 30],
    "n_components": [2, 3, 5, 10],
    "min_dist": [0.0, 0.1, 0.25, 0.5],
}
DEFAULT_DENSITY_SPACE = {
    "min_cluster_size": [5, 10, 15, 20, 25, 30],
    "min_samples": [1, 5, 10, 15, 20],
    "cluster_selection_epsilon": [0.0, 0.1, 0.2, 0.3],
}
ADJUSTED_REDUCTION_SPACE = {
    "n_neighbors": list(range(30, 50, 2)),
    "n_components": [2, 3],
    "min_dist": [0.0, 0.1, 0.25],
}
ADJUSTED_DENSITY_SPACE = {
    "min_cluster_size": list(range(100, 200, 20)),
    "min_samples": list(range(50, 150, 5)),
}
ORIGINAL_REDUCTION_SPACE = {
    "n_neighbors": [30, 45, 60, 75, 90],
    "n_components": [2, 3],
    "min_dist": [0.0, 0.1, 0.25],
}
ORIGINAL_DENSITY_SPACE = {
    "min_cluster_size": [10, 20, 30, 40],
    "min_samples": [10, 20, 30, 40],
}
COUNT_PENALTY = 0.15
PARAMETERS = ["n_neighbors", "n_components", "min_cluster_size", "min_samples", "min_dist"]
RESULT_COLUMNS = [*PARAMETERS, "n_clusters", "noise_ratio", "dbcv_score"]


def with_grid(df: DataFrame, space: Mapping[str, Sequence]) -> DataFrame:
    """Every row once per combination of the (short) value lists, plus ``cell_id``."""
    sizes = [len(v) for v in space.values()]
    cell = F.lit(0).cast("long")
    out = df
    for size, (name, values) in zip(sizes, space.items()):
        out = out.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_i_{name}", name))
        cell = cell * size + F.col(f"_i_{name}")
    return out.withColumn("cell_id", cell).drop(*[f"_i_{n}" for n in space])


def grid_table(spark: SparkSession, space: Mapping[str, Sequence]) -> DataFrame:
    return with_grid(spark.range(1).drop("id"), space)


def grid_size(space: Mapping[str, Sequence], folds: int = 1) -> int:
    """Number of fits of a grid."""
    cells = 1
    for values in space.values():
        cells *= len(values)
    return cells * folds


def penalised_loss(lower: int, upper: int, cost: str = "cost", count: str = "label_count") -> Column:
    """Cost, plus a fixed penalty when the cluster count is outside ``lower .. upper``."""
    inside = F.col(count).between(lower, upper)
    return F.col(cost) + F.when(inside, F.lit(0.0)).otherwise(F.lit(COUNT_PENALTY))


def trial_rank(trials: DataFrame, score: str, ascending: bool = False) -> DataFrame:
    order = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return trials.withColumn("rank_score", F.rank().over(Window.orderBy(order)).cast("long"))


def cell_summary(scores: DataFrame, cell: Sequence[str], score: str = "score", ascending: bool = False) -> DataFrame:
    """Mean, population deviation and rank of each grid cell over its folds (one row per cell and fold)."""
    cells = scores.groupBy(*cell).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))
    return trial_rank(cells, "mean_score", ascending)


def best_trial(trials: DataFrame, score: str = "cost", key: str = "run_id") -> DataFrame:
    """The row of the lowest score, ties to the lowest key."""
    everything = F.struct(*trials.columns)
    return trials.where(F.col(score).isNotNull()).agg(
        F.min_by(everything, F.struct(score, key)).alias("_t")).select("_t.*")


def result_row(best: DataFrame, method: str, model: str) -> DataFrame:
    """The best trial as a row of the result table: method, time, parameters, counts, score, model.

    Parameters the method doesn't have are NULL.
    """
    kinds = {"noise_ratio": "double", "dbcv_score": "double", "min_dist": "double"}
    columns = [F.col(c) if c in best.columns else F.lit(None) for c in RESULT_COLUMNS]
    return best.select(
        F.lit(method).alias("method"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        *[c.cast(kinds.get(n, "int")).alias(n) for c, n in zip(columns, RESULT_COLUMNS)], F.lit(model).alias("model"))


def consolidated(results: Sequence[DataFrame]) -> DataFrame:
    """Result tables of the methods together, best quality first, missing scores last."""
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.orderBy(F.col("dbcv_score").desc_nulls_last(), F.col("method"))


def best_per_method(results: DataFrame, score: str = "dbcv_score") -> DataFrame:
    return results.groupBy("method").agg(F.max(score).alias(score))


def random_draws(spark: SparkSession, space: Mapping[str, Sequence], count: int, seed: int = 42) -> DataFrame:
    """Independent draws per parameter, with a run id."""
    rng = random.Random(seed)
    rows = [(i, *[_plain(rng.choice(list(space[p]))) if p in space else _missing(p) for p in PARAMETERS])
            for i in range(count)]
    return small_table(spark, rows, _trial_parameters())


def _missing(parameter: str):
    return {"min_samples": 10, "min_dist": 0.0}[parameter]


def _plain(value):
    return float(value) if isinstance(value, float) else int(value)


def _trial_parameters() -> str:
    return "run_id long, n_neighbors int, n_components int, min_cluster_size int, min_samples int, min_dist double"


def propose(trials: DataFrame, space: Mapping[str, Sequence], gamma: float = 0.25,
            loss: str = "loss") -> DataFrame:
    """Per parameter value: how much likelier among the good trials than among the rest.

    Trials are split at the gamma quantile of the loss; counts are smoothed by one.
    Returns ``parameter, value, good, bad, ratio, choice`` (choice: the value to try next).
    """
    ranked = trials.withColumn("_r", F.row_number().over(Window.orderBy(loss, "run_id"))) \
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    marked = ranked.withColumn("_good", F.col("_r") <= F.ceil(F.col("_n") * F.lit(gamma)))
    seen = marked.select("_good", F.explode(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("value")) for p in space
    ])).alias("_s")).groupBy("_s.parameter", "_s.value").agg(
        F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad"))
    # Smoothing needs the trial counts and the number of choices of each parameter.
    totals = Window.partitionBy("parameter")
    choices = F.lit(None).cast("int")
    for p, values in space.items():
        choices = F.when(F.col("parameter") == p, F.lit(len(values))).otherwise(choices)
    scored = (
        seen.withColumn("_g", F.sum("good").over(totals)).withColumn("_b", F.sum("bad").over(totals))
        .withColumn("_k", choices)
        .withColumn("ratio", ((F.col("good") + 1) / (F.col("_g") + F.col("_k")))
                    / ((F.col("bad") + 1) / (F.col("_b") + F.col("_k"))))
    )
    first = F.row_number().over(totals.orderBy(F.col("ratio").desc(), F.col("value"))) == 1
    return scored.select("parameter", "value", "good", "bad", "ratio", first.alias("choice"))


def evaluate_trials(points: DataFrame, trials: list[dict], lower: int = 2, upper: int = 1 << 30,
                    seed: int = 42, iterations: int = 8, id_col: str = "idx_global", vec_col: str = "embedding"
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reduce and cluster for every trial together.

    Trials (parameter dicts with ``run_id``) share what they can: one cosine graph for all,
    one layout per ``n_neighbors``, one density forest per layout size and
    ``min_samples``, one hierarchy for all ``min_cluster_size``. ``min_dist`` only
    stretches a layout, which leaves density labels unchanged.
    Returns (per-trial scores, labels ``run_id, node, label, prob``, coordinates
    ``g, node, coords``), where ``g`` numbers the (n_neighbors, n_components) pairs.
    """
    spark = points.sparkSession
    shapes = sorted({(t["n_neighbors"], t["n_components"]) for t in trials})
    made = reduce.layouts(points, sorted({s[0] for s in shapes}), max(s[1] for s in shapes),
                          seed, iterations, id_col, vec_col)
    shape_rows = small_table(spark, [(i, nn, nc) for i, (nn, nc) in enumerate(shapes)],
                                       "g int, nn int, nc int")
    # One row per shape of the search space.
    coords = cut(made.join(F.broadcast(shape_rows), "nn").join(_weights(points, id_col, vec_col), "node").select(
        "g", "node", "n", F.slice("coords", F.lit(1), F.col("nc")).alias("coords")), "trial-coords")
    samples = sorted({t["min_samples"] for t in trials})
    nodes, forest = density.density_forest(coords, samples, None, "g", "node", "coords", weight="n")
    keys = ["g", "ms"]
    labels = density.select_clusters(nodes, density.hierarchy(nodes, forest, keys), keys,
                                     sorted({t["min_cluster_size"] for t in trials}))
    plan = small_table(spark,
        [(t["run_id"], shapes.index((t["n_neighbors"], t["n_components"])), t["min_samples"],
          t["min_cluster_size"]) for t in trials], "run_id long, g int, ms int, mcs int")
    # One row per trial.
    per_trial = cut(_spread_nodes(coords, labels).join(F.broadcast(plan), ["g", "ms", "mcs"]).select(
        "run_id", "g", "node", "n", "label", "prob"), "trial-labels")
    low = F.sum(F.when(F.col("prob") < quality.LOW_PROBABILITY, F.col("n")).otherwise(0))
    per_label = per_trial.groupBy("run_id", "label").agg(F.sum("n").alias("n"), low.alias("low"))
    total = F.sum("n")
    scores = per_label.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("label_count"), F.count_if(F.col("label") >= 0).alias("n_clusters"),
        (F.sum(F.when(F.col("label") == -1, F.col("n")).otherwise(0)) / total).alias("noise_ratio"),
        (F.sum("low") / total).alias("cost"))
    params = small_table(spark,
        [(t["run_id"], *[t[p] for p in PARAMETERS]) for t in trials], _trial_parameters())
    scored = params.join(scores, "run_id").withColumn("loss", penalised_loss(lower, upper))
    return cut(scored, "trial-scores"), per_trial.select("run_id", "g", "node", "label", "prob"), coords


def _weights(points: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """How many rows each layout node (different vector) stands for."""
    return tiles.distinct_vectors(points, [], id_col, vec_col).select(
        F.col("id").alias("node"), F.col("copies").alias("n"))


def _spread_nodes(coords: DataFrame, labels: DataFrame) -> DataFrame:
    """Layout nodes with equal coordinates share the label of the first."""
    rows = coords.select("g", F.col("node").alias("_n"), "n", F.col("coords").alias("_v"))
    distinct = tiles.write_distinct(rows, ["g"], "_n", "_v", "layout-distinct")
    return tiles.with_rep(rows, distinct, ["g"], "_n", "_v", "node").join(
        labels, ["g", "node"]).drop("node").withColumnRenamed("_n", "node")


def _quality_of_best(labels: DataFrame, coords: DataFrame, run_id: int) -> float | None:
    """Simplified density validity of one trial in its reduced space."""
    chosen = labels.where(F.col("run_id") == run_id).join(coords, ["g", "node"])
    row = quality.dbcv(chosen, "label", "node", "coords", weight="n").first()
    return None if row is None else row["dbcv_score"]


def _finish(scored: DataFrame, labels: DataFrame, coords: DataFrame, order: str):
    # The trial table has one row per trial of the search; the best row is all the driver needs.
    best = best_trial(scored, order).first().asDict()
    score = _quality_of_best(labels, coords, best["run_id"])
    value = F.when(F.col("run_id") == best["run_id"], F.lit(score)).cast("double")
    table = scored.withColumn("dbcv_score", value).orderBy(order, "run_id")
    return table, {**best, "dbcv_score": score}, labels.where(F.col("run_id") == best["run_id"])


def random_search(points: DataFrame, space: Mapping[str, Sequence], num_evals: int, seed: int = 42, **kw):
    """Evaluate random draws in one job, best by cost. Returns (trials, best, labels of the best)."""
    spark = points.sparkSession
    draws = [r.asDict() for r in random_draws(spark, space, num_evals, seed).collect()]
    return _finish(*evaluate_trials(points, draws, seed=seed, **kw), "cost")


def bayesian_search(points: DataFrame, space: Mapping[str, Sequence], label_lower: int,
                    label_upper: int, max_evals: int = 20, batch: int = 5, seed: int = 42, **kw):
    """Model-based search in small batches, minimising the penalised loss.

    The first batch is random; later ones take the likeliest good value of each
    parameter and vary the rest by seeded draws weighted with the same ratios.
    """
    spark = points.sparkSession
    rng = random.Random(seed)
    lists = {p: list(space.get(p, [_missing(p)] if p in ("min_samples", "min_dist") else [])) for p in PARAMETERS}
    tables, done = [], 0
    while done < max_evals:
        size = min(batch, max_evals - done)
        if not tables:
            pick = [{p: rng.choice(v) for p, v in lists.items()} for _ in range(size)]
        else:
            seen = tables[0][0]
            for t in tables[1:]:
                seen = seen.unionByName(t[0])
            ratios = {(r["parameter"], r["value"]): r["ratio"] for r in propose(seen, lists).collect()}
            best = {p: max(v, key=lambda x: ratios.get((p, float(x)), 1.0)) for p, v in lists.items()}
            pick = [best] + [{p: rng.choices(v, [ratios.get((p, float(x)), 1.0) for x in v])[0]
                              for p, v in lists.items()} for _ in range(size - 1)]
        trials = [{"run_id": done + i, **{p: _plain(v) if p != "min_dist" else float(v)
                                          for p, v in t.items()}} for i, t in enumerate(pick)]
        tables.append(evaluate_trials(points, trials, label_lower, label_upper, seed=seed, **kw))
        done += size
    scored, labels = tables[0][0], tables[0][1]
    for t in tables[1:]:
        scored, labels = scored.unionByName(t[0]), labels.unionByName(t[1])
    best = best_trial(scored, "loss").first().asDict()
    # Coordinates of the batch the best trial was in.
    coords = tables[best["run_id"] // batch][2]
    return _finish(scored, labels, coords, "loss")


def separate_grid_search(points: DataFrame, reduction_space: Mapping[str, Sequence] | None = None,
                         density_space: Mapping[str, Sequence] | None = None, seed: int = 42,
                         iterations: int = 8, id_col: str = "idx_global", vec_col: str = "embedding", folds: int = 3):
    """Best reduction by spread, then best clustering by silhouette minus noise, both on held-out folds.

    Every cell is fitted on all folds but one and scored on that one's rows (``heldout``);
    cells are ranked by the mean of their folds. The best cells are then fitted on all rows.
    Returns (summary row, best parameters, reduction cells, clustering cells, labels of the best).
    """
    spark = points.sparkSession
    rspace = dict(reduction_space or DEFAULT_REDUCTION_SPACE)
    dspace = {"cluster_selection_epsilon": [0.0], **dict(density_space or DEFAULT_DENSITY_SPACE)}
    scores = heldout.reduction_scores(points, rspace, grid_table(spark, rspace), folds, seed=seed, iterations=iterations,
                                      id_col=id_col, vec_col=vec_col)
    cells = cut(cell_summary(scores, ["cell_id", *rspace]), "grid-reduction")
    best_r = cells.orderBy("rank_score", "cell_id").first()
    made = reduce.layouts(points, [best_r["n_neighbors"]], max(rspace["n_components"]), seed, iterations, id_col, vec_col)
    layout = reduce.stretch(made, best_r["n_components"], best_r["min_dist"]).select("node", "coords")
    rows = cut(density.attach_nodes(points, layout, [], id_col, vec_col), "grid-coords")
    names = ["min_cluster_size", "min_samples", "cluster_selection_epsilon"]
    dcells = cut(cell_summary(heldout.density_scores(rows, dspace, folds, id_col), ["cell_id", *names]), "grid-density")
    best_d = dcells.orderBy("rank_score", "cell_id").first()
    weighted = layout.join(_weights(points, id_col, vec_col), "node").select(F.lit(0).alias("g"), "node", "n", "coords")
    weighted = cut(weighted, "grid-nodes")
    nodes, forest = density.density_forest(weighted, [best_d["min_samples"]], None, "g", "node", "coords", weight="n")
    keys = ["g", "ms"]
    labels = density.select_clusters(nodes, density.hierarchy(nodes, forest, keys), keys, [best_d["min_cluster_size"]],
                                     best_d["cluster_selection_epsilon"])
    chosen = cut(_spread_nodes(weighted, labels).join(layout, "node").select("node", "n", "label", "prob", "coords"), "grid-labels")
    counts = quality.cluster_counts(chosen, weight="n").first()
    valid = quality.dbcv(chosen, "label", "node", "coords", weight="n").first()
    score = None if valid is None else valid["dbcv_score"]
    best = {**{p: best_r[p] for p in rspace}, **{p: best_d[p] for p in names}}
    summary = small_table(spark,
        [(0, best["n_neighbors"], best["n_components"], best["min_cluster_size"], best["min_samples"],
          float(best["min_dist"]), counts["n_clusters"], counts["n_clusters"], counts["noise_ratio"],
          counts["noise_ratio"], score)], TRIALS_DDL)
    return summary, best, cells, dcells, chosen.select("node", "label", "prob")
