"""From vectors to labelled vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import density, quality, reduce
from kindred.session import cut
from kindred.sources import vectors as vec


def generate_clusters(points: DataFrame, n_neighbors: int, n_components: int, min_cluster_size: int,
                      min_samples: int = 10, min_dist: float = 0.0, seed: int = 42,
                      id_col: str = "idx_global",
                      vec_col: str = "embedding") -> DataFrame:
    """Reduce, then cluster: ``id_col, coords, label, prob`` for every point."""
    coords = cut(reduce.reduce_layout(points, n_neighbors, n_components, min_dist, seed,
                                      id_col=id_col, vec_col=vec_col), "coords")
    labels = density.density_cluster(coords, min_cluster_size, min_samples,
                                     id_col=id_col, vec_col="coords")
    return coords.join(labels, id_col)


def score_clusters(clusters: DataFrame, threshold: float = quality.LOW_PROBABILITY) -> DataFrame:
    """Label counts, noise and the share of uncertain points: per label first, then over the labels."""
    per_label = clusters.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob") < threshold).alias("low"))
    noise = F.sum(F.when(F.col("label") == quality.NOISE, F.col("n")))
    return per_label.agg(
        F.count(F.lit(1)).alias("label_count"), F.count_if(F.col("label") >= 0).alias("n_clusters"),
        (F.coalesce(noise, F.lit(0)) / F.sum("n")).alias("noise_ratio"), F.sum("n").alias("n_points"),
        (F.sum("low") / F.sum("n")).alias("cost"))


def write_clusters(points: DataFrame, clusters: DataFrame, folder: str, files_per_label: int = 1,
                   id_col: str = "idx_global") -> None:
    """Labelled vectors in the original and in the reduced space, both in folders by label."""
    folder = folder.rstrip("/")
    original = points.join(clusters.select(id_col, "label", "prob"), id_col)
    reduced = clusters.select(id_col, F.col("coords").alias("embedding"), "label", "prob")
    vec.write_labelled(original, f"{folder}/original", files_per_label, id_col=id_col)
    vec.write_labelled(reduced, f"{folder}/reduced", files_per_label, id_col=id_col)
