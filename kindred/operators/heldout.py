"""Held-out scores of grid cells: every cell is fitted on all folds but one and scored on the rows of that one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators import density, neighbours, quality, ranks, reduce, split
from kindred.session import cut


def _others(side: Column, folds: int) -> Column:
    """The folds that are left out while the rows of fold ``side`` are trained on."""
    return F.explode(F.filter(F.array(*[F.lit(f) for f in range(folds)]), lambda f: f != side)).alias("fold")


def fold_vectors(points: DataFrame, folds: int = 3, id_col: str = "idx_global", vec_col: str = "embedding") -> DataFrame:
    """The different vectors with the contiguous folds they lie in: ``node, vec, parts`` (fold, n: its copies there).

    ``node`` is the lowest id. Copies may lie in several folds: such a vector is
    trained on where another fold than one of its own is left out, and held out too.
    """
    placed = split.kfold(points.select(id_col, vec_col), folds, id_col)
    per_fold = placed.groupBy(F.col(vec_col).alias("vec"), "fold").agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
    # At most one entry per fold in a list.
    return cut(per_fold.groupBy("vec").agg(F.min("id").alias("node"), F.sort_array(
        F.collect_list(F.struct("fold", "n"))).alias("parts")).select("node", "vec", "parts"), "fold-vectors")


def fold_neighbours(vectors: DataFrame, k: int, folds: int = 3, metric: str = "cosine") -> tuple[DataFrame, DataFrame]:
    """(graph, held): ``fold, node, neighbour, dist, rank``, the ``k`` nearest trained vectors when ``fold`` is left out.

    ``graph`` lists the other trained vectors near each trained one, ``held`` the
    trained vectors near each held-out one (its own copy among them). One search
    serves all folds: the k + 1 nearest inside each fold; those of all folds but
    one hold the nearest of their union. So each pair of vectors meets once, as in
    the graph of all rows, whatever the number of folds.
    """
    corpus = vectors.select("node", F.explode("parts.fold").alias("side"), F.col("vec").alias("embedding"))
    asked = vectors.select(F.col("node").alias("query_id"), F.explode(F.array(*[F.lit(f) for f in range(folds)])).alias("side"),
                           F.col("vec").alias("embedding"))
    hits = cut(neighbours.knn_join(asked, corpus, k + 1, metric, by="side", id_col="node").select(
        "side", F.col("query_id").alias("node"), F.col("node").alias("neighbour"), "dist"), "fold-hits")
    # A neighbour with copies in several folds comes once from each.
    near = hits.select("node", "neighbour", "dist", _others(F.col("side"), folds)).groupBy("fold", "node", "neighbour").agg(
        F.min("dist").alias("dist"))
    member = vectors.select("node", F.explode("parts.fold").alias("side"))
    trained = member.select("node", _others(F.col("side"), folds)).distinct()
    order = [F.col("dist"), F.col("neighbour")]
    graph = ranks.top_n(near.where("node <> neighbour").join(trained, ["fold", "node"]), ["fold", "node"], order, k)
    held = ranks.top_n(near.join(member.withColumnRenamed("side", "fold"), ["fold", "node"]), ["fold", "node"], order, k)
    return graph, held


def fold_layouts(points: DataFrame, n_neighbors: Sequence[int], n_components: int, folds: int = 3, seed: int = 42,
                 iterations: int = 8, id_col: str = "idx_global", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(fitted, placed) for every ``nn`` and left-out ``fold``: unscaled ``coords`` of trained and of held-out vectors.

    Layouts of all folds and sizes take their rounds in the same jobs. A held-out
    vector lies at the similarity-weighted mean of its ``nn`` nearest trained ones;
    ``n`` is the number of its rows in the fold.
    """
    vectors = fold_vectors(points, folds, id_col, vec_col)
    graph, held = fold_neighbours(vectors, max(n_neighbors), folds)
    edges = reduce.fuzzy_edges(cut(graph, "fold-graph"), n_neighbors, by=["fold"])
    # The layout takes one number per graph.
    numbered = edges.select((F.col("nn") * folds + F.col("fold")).alias("nn"), "a", "b", "w")
    fitted = cut(reduce.spectral_layout(numbered, vectors.select("node", F.col("vec").alias("embedding")), n_components, seed,
                                        iterations).select(F.floor(F.col("nn") / folds).cast("int").alias("nn"),
                                                           (F.col("nn") % folds).cast("int").alias("fold"), "node", "coords"), "fold-layouts")
    sizes = F.explode(F.array(*[F.lit(int(n)) for n in sorted(set(n_neighbors))])).alias("nn")
    weight = F.lit(1.0) / (F.col("dist") + F.lit(1e-9))
    near = held.select("fold", "node", F.col("neighbour"), weight.alias("w"), "rank", sizes).where("rank <= nn").join(
        fitted.withColumnRenamed("node", "neighbour"), ["nn", "fold", "neighbour"])
    mean = near.groupBy("nn", "fold", "node").agg(*[
        (F.sum(F.col("w") * F.col("coords")[i]) / F.sum("w")).alias(f"c{i}") for i in range(n_components)])
    copies = vectors.select("node", F.inline("parts"))
    placed = mean.join(copies, ["fold", "node"]).select(
        "nn", "fold", "node", "n", F.array(*[f"c{i}" for i in range(n_components)]).alias("coords"))
    return fitted, cut(placed, "fold-placed")


def reduction_scores(points: DataFrame, space: Mapping[str, Sequence], cells: DataFrame, folds: int = 3, **how) -> DataFrame:
    """``cell_id, <parameters>, fold, score``: minus the variance of the held-out rows' scaled coordinates.

    ``cells`` is the grid of ``space`` as a table, one row per cell. Held-out rows are scaled as the trained ones are. All cells of one ``n_neighbors``
    read the same layouts: sums per coordinate give their spread. A layout that is a
    single point has no score.
    """
    fitted, placed = fold_layouts(points, space["n_neighbors"], max(space["n_components"]), folds, **how)
    keys = ["nn", "fold", "i"]
    extent = fitted.select("nn", "fold", F.posexplode("coords").alias("i", "x")).groupBy(*keys).agg(F.max(F.abs("x")).alias("m"))
    sums = placed.select("nn", "fold", "n", F.posexplode("coords").alias("i", "x")).groupBy(*keys).agg(
        F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("q"), F.sum("n").alias("n"))
    # One row per value of the space, fold and coordinate.
    rows = F.broadcast(cut(extent.join(sums, keys), "fold-spread"))
    scored = cells.join(rows, F.col("nn") == F.col("n_neighbors")).where(
        F.col("i") < F.col("n_components")).groupBy("cell_id", *space, "fold").agg(
        F.max("m").alias("m"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    factor = F.lit(10.0) * (1 + F.col("min_dist")) / F.nullif(F.col("m"), F.lit(0.0))
    mean = F.col("s") / F.col("n")
    return scored.withColumn("score", factor * factor * (mean * mean - F.col("q") / F.col("n"))).drop("m", "s", "q", "n")


def density_scores(coords: DataFrame, space: Mapping[str, Sequence], folds: int = 3, id_col: str = "idx_global",
                   vec_col: str = "coords") -> DataFrame:
    """``cell_id, <parameters>, fold, n_clusters, noise_ratio, score`` of the held-out rows of every cell.

    The trees of all folds are grown in the same jobs. A held-out row takes the label of the
    nearest trained one; the score is the silhouette of the held-out rows that are
    not noise, minus their share of noise (-1 with fewer than two clusters).
    """
    vectors = fold_vectors(coords, folds, id_col, vec_col)
    parts = vectors.select("node", "vec", F.explode("parts").alias("p")).select("node", "vec", "p.fold", "p.n")
    trained = cut(parts.select("node", "vec", "n", _others(F.col("fold"), folds)).groupBy("fold", "node", "vec").agg(
        F.sum("n").alias("n")).select(F.col("fold").alias("g"), "node", "n", F.col("vec").alias("coords")), "fold-trained")
    held = cut(parts.withColumnRenamed("fold", "g"), "fold-held")
    nearest = cut(neighbours.knn_join(
        held.select("g", F.col("node").alias("query_id"), F.col("vec").alias("embedding")), trained, 1, "euclidean", by="g",
        id_col="node", vec_col="coords").select("g", "query_id", "node"), "fold-nearest")
    samples, sizes = sorted(set(space["min_samples"])), sorted(set(space["min_cluster_size"]))
    nodes, forest = density.density_forest(trained, samples, None, "g", "node", "coords", weight="n")
    tree, every = density.hierarchy(nodes, forest, ["g", "ms"]), None
    for eps in space.get("cluster_selection_epsilon", [0.0]):
        made = density.select_clusters(nodes, tree, ["g", "ms"], sizes, eps).select(
            "g", "ms", "mcs", F.lit(float(eps)).alias("eps"), "node", "label")
        every = made if every is None else every.unionByName(made)
    given = nearest.join(every, ["g", "node"]).drop("node").withColumnRenamed("query_id", "node").join(held, ["g", "node"])
    # A number for every cell and fold: positions in the lists of the space.
    listed = [("mcs", sizes), ("ms", samples), ("eps", [float(e) for e in space.get("cluster_selection_epsilon", [0.0])])]
    cell = F.lit(0)
    for name, values in listed:
        kind = given.schema[name].dataType
        cell = cell * len(values) + F.array_position(F.array(*[F.lit(v).cast(kind) for v in values]), F.col(name)) - 1
    rows = cut(given.select((cell * folds + F.col("g")).cast("long").alias("cell"), "mcs", "ms", "eps", "g", "node", "n", "label",
                            F.col("vec").alias("coords")), "fold-labels")
    names = rows.select("cell", "mcs", "ms", "eps", "g").distinct().withColumnRenamed("g", "fold")
    scored = quality.silhouette(rows, "label", "node", "coords", by="cell", weight="n")
    return names.join(scored.withColumnRenamed("g", "cell"), "cell").select(
        F.floor(F.col("cell") / folds).alias("cell_id"), F.col("mcs").alias("min_cluster_size"), F.col("ms").alias("min_samples"), F.col("eps").alias("cluster_selection_epsilon"),
        "fold", "n_clusters", "noise_ratio", "score")
