"""Held-out grid scores against separate fits of every fold; pruned search inside groups against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import group_cells, heldout, neighbours, reduce, search, split


def crowd(blobs):
    """The blobs in shuffled order with copies of one row in several folds."""
    x, _ = blobs
    x = np.random.default_rng(3).permutation(x)
    return np.concatenate([x[:70], np.repeat(x[:1], 20, axis=0), x[70:], x[:5]])


def test_reduction_scores_are_those_of_separate_fits(spark, vectors, blobs):
    points = vectors(crowd(blobs))
    space = {"n_neighbors": [6, 10], "n_components": [2, 3], "min_dist": [0.0, 0.5]}
    got = {(r.n_neighbors, r.n_components, r.min_dist, r.fold): r.score for r in heldout.reduction_scores(
        points, space, search.grid_table(spark, space), 2, iterations=2).collect()}
    assert len(got) == 8 * 2
    placed = split.kfold(points, 2).persist()
    for fold in range(2):
        train, held = (placed.where(c).drop("fold", "label") for c in (f"fold <> {fold}", f"fold = {fold}"))
        made = reduce.layouts(train, [6, 10], 3, iterations=2).persist()
        fitted = train.groupBy("embedding").agg(F.min("idx_global").alias("idx_global"))
        for nn in (6, 10):
            for nc, md in ((2, 0.0), (3, 0.5)):
                coords = reduce.stretch(made.where(made.nn == nn), nc, md).select(F.col("node").alias("idx_global"), "coords")
                out = np.array([r.coords for r in reduce.place_new(held, fitted, coords, nn).collect()])
                assert len(out) == held.count()
                assert got[nn, nc, md, fold] == pytest.approx(-np.var(out), rel=1e-6)


def test_density_scores_of_held_out_rows(spark, vectors, blobs):
    x, _ = blobs
    low = np.random.default_rng(5).permutation(x[:, :2])
    points = vectors(low).withColumn("coords", F.col("embedding").cast("array<double>"))
    space = {"min_cluster_size": [5, 20], "min_samples": [3, 6]}
    rows = heldout.density_scores(points, space).collect()
    assert sorted((r.cell_id, r.fold) for r in rows) == [(c, f) for c in range(4) for f in range(3)]
    from kindred.operators import density, quality
    placed = split.kfold(points, 3).persist()
    for fold in (1,):
        train = placed.where(f"fold <> {fold}").drop("label")
        labels = {r.idx_global: r.label for r in density.density_cluster(train, 20, 3, vec_col="coords").collect()}
        t = {r.idx_global: np.array(r.coords) for r in train.collect()}
        held = placed.where(f"fold = {fold}").collect()
        given = [labels[min(t, key=lambda i: (np.linalg.norm(t[i] - np.array(h.coords)), i))] for h in held]
        want = quality.silhouette(vectors([h.coords for h in held], given)).first()
        one = next(r for r in rows if (r.min_cluster_size, r.min_samples, r.fold) == (20, 3, fold))
        assert one.n_clusters == want.n_clusters and one.noise_ratio == pytest.approx(want.noise_ratio)
        assert one.score == pytest.approx(want.score, abs=1e-5)


def test_grid_search_ranks_by_the_mean_of_its_folds(vectors, blobs):
    points = vectors(crowd(blobs))
    summary, best, cells, dcells, labels = search.separate_grid_search(
        points, {"n_neighbors": [6, 10], "n_components": [2], "min_dist": [0.0, 0.5]},
        {"min_cluster_size": [10, 20], "min_samples": [4]}, iterations=2)
    for table in (cells.collect(), dcells.collect()):
        means = [r.mean_score for r in table]
        assert all(r.rank_score == 1 + sum(m > r.mean_score for m in means) and r.std_score >= 0 for r in table)
    assert best["min_dist"] == 0.0 and best["cluster_selection_epsilon"] == 0.0
    row = summary.first()
    assert row.n_clusters == labels.where("label >= 0").select("label").distinct().count() >= 2


def brute_groups(x, groups, k, metric):
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    out = {}
    for i in range(len(x)):
        same = [j for j in range(len(x)) if groups[j] == groups[i] and j != i]
        d = 1 - unit[same] @ unit[i] if metric == "cosine" else np.linalg.norm(x[same] - x[i], axis=1)
        out[i] = np.sort(d)[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_group_cells_find_what_all_tiles_find(spark, vectors, metric, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 30
    hot = np.concatenate([c + rng.normal(size=(60, 6)) for c in centres])
    x = np.concatenate([hot, hot[:40], rng.normal(size=(30, 6)), np.zeros((3, 6)), rng.normal(size=(1, 6))]).astype(np.float32)
    groups = [0] * 760 + [1] * 30 + [2] * 2 + [0] + [3]
    frame = vectors(x, groups)
    compared = []
    real = neighbours._run_pairs

    def counted(q_tiles, c_tiles, partners, q_keys, c_keys, *rest):
        stored = c_tiles.groupBy(*c_keys).agg(F.sum(F.size("c_id")).alias("m"))
        pairs = q_tiles.drop("slot").join(partners, q_keys).join(stored, c_keys)
        compared.append(pairs.agg(F.sum(F.size("q_id") * F.col("m"))).first()[0] or 0)
        return real(q_tiles, c_tiles, partners, q_keys, c_keys, *rest)

    monkeypatch.setattr(neighbours, "_run_pairs", counted)
    whole = neighbours.knn_graph(frame, 5, metric, by="label", tile_rows=16).collect()
    full, compared[:] = sum(compared), []
    found = neighbours.knn_graph(frame, 5, metric, by="label", tile_rows=16, search=group_cells.pivot_pairs).collect()
    assert sum(compared) < full / 2
    assert len(found) == len(whole)
    want = brute_groups(x.astype(np.float64), groups, 5, metric)
    near = {}
    for r in found:
        near.setdefault(r.idx_global, []).append(r.dist)
    for i, d in want.items():
        assert np.allclose(sorted(near.get(i, [])), d, atol=1e-6), i


def test_group_cells_of_no_rows_and_missing_groups(spark, vectors):
    frame = vectors(np.eye(4), [0, 0, 1, 1])
    asked = vectors(np.eye(4), [0, 1, 2, 2]).withColumnRenamed("idx_global", "query_id")
    got = neighbours.group_topk(asked, frame, 3, search=group_cells.pivot_pairs).collect()
    assert sorted((r.query_id, r.idx_global) for r in got) == [(0, 0), (0, 1), (1, 2), (1, 3)]
    assert not neighbours.group_topk(asked.limit(0), frame, 3, search=group_cells.pivot_pairs).count()
    assert not neighbours.group_topk(asked, frame.limit(0), 3, search=group_cells.pivot_pairs).count()
