"""The grid search and the inverted lists against brute force; the contraction of a cluster tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import cells, density, inverted, neighbours
from kindred.session import cut


def brute(x, ids, k, groups=None):
    out = []
    for i, a in enumerate(x):
        d = np.sqrt(((x - a) ** 2).sum(1))
        order = sorted((round(d[j], 9), ids[j]) for j in range(len(x)) if j != i and (groups is None or groups[j] == groups[i]))
        out += [(ids[i], r + 1, o[0]) for r, o in enumerate(order[:k])]
    return sorted(out)


def same(graph, want):
    got = sorted((r["idx_global"], r["rank"], r["dist"]) for r in graph.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-6, atol=1e-7)


def shapes():
    rng = np.random.default_rng(3)
    yield "uniform", rng.uniform(size=(600, 2))
    yield "blobs", np.concatenate([rng.normal(c, s, size=(150, 3)) for c, s in ((0, 1), (50, 1e-3), (-9, 5), (1e4, 1e-6))])
    yield "line", np.stack([np.repeat(np.arange(30.0), 20), np.tile(np.arange(20.0), 30) * 1e-3], 1)
    yield "copies", np.concatenate([np.zeros((200, 4)), rng.normal(size=(300, 4)), np.ones((5, 4))])
    yield "far outliers", np.concatenate([rng.normal(size=(400, 2)), [[1e9, 0], [0, -1e9], [1e9, 1]]])


@pytest.mark.parametrize("name,x", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_grid_equals_brute_force(vectors, name, x):
    x = x.astype(np.float32)
    got = neighbours.knn_graph(vectors(x), 7, "euclidean", search=cells.grid_pairs, tile_rows=16)
    same(got, brute(x.astype(float), list(range(len(x))), 7))


def test_grid_inside_groups_and_other_queries(spark, vectors):
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=(500, 3)).astype(np.float32), [0] * 400 + [1] * 96 + [2] * 3 + [3]
    got = neighbours.knn_graph(vectors(x, g), 4, "euclidean", by="label", search=cells.grid_pairs, tile_rows=16)
    same(got, brute(x.astype(float), list(range(500)), 4, g))
    asked = vectors(rng.normal(size=(40, 3)) * 5, ids=range(1000, 1040)).withColumnRenamed("idx_global", "query_id")
    with_grid = neighbours.knn_join(asked, vectors(x), 5, "euclidean", search=cells.grid_pairs, tile_rows=16)
    assert sorted(with_grid.collect()) == sorted(neighbours.knn_join(asked, vectors(x), 5, "euclidean").collect())
    for empty in (neighbours.knn_join(asked.where("false"), vectors(x), 5, "euclidean", search=cells.grid_pairs),
                  neighbours.knn_join(asked, vectors(x).where("false"), 5, "euclidean", search=cells.grid_pairs)):
        assert empty.collect() == []


@pytest.mark.parametrize("first", [2, 3])
def test_grid_groups_of_different_dimensions(spark, first):
    """Layouts of 2 and 3 components are searched in the same jobs, each in all of its dimensions."""
    rng, rows, want = np.random.default_rng(6), [], []
    for g, dims in enumerate((first, 5 - first)):
        x = rng.normal(size=(300, dims)) * [1.0, 1.0, 40.0][:dims]
        ids = list(range(1000 * g, 1000 * g + 300))
        rows += [(i, g, [float(a) for a in v]) for i, v in zip(ids, x)]
        want += brute(x, ids, 6)
    table = spark.createDataFrame(rows, "idx_global long, g int, embedding array<double>").coalesce(1)
    same(neighbours.knn_graph(table, 6, "euclidean", by="g", search=cells.grid_pairs, tile_rows=16).drop("g"), sorted(want))


def test_grid_opens_few_cells(spark):
    """Pairs of cells grow about in proportion to the points, not with their square."""
    pairs = {}
    for n in (2000, 8000):
        x = np.random.default_rng(1).uniform(size=(n, 2))
        points = spark.createDataFrame([(i, [float(a) for a in v], True) for i, v in enumerate(x)], "id long, v array<double>, asked boolean")
        points = points.unionByName(points.withColumn("asked", F.lit(False)))
        placed, levels = cells.grow(points, [], 2, 6, 32)
        assert placed.groupBy("cell", "asked").count().agg(F.max("count")).first()[0] <= 32
        leaves = levels[0].where("leaf")
        for level in levels[1:]:
            leaves = leaves.unionByName(level.where("leaf"))
        count = leaves.count()
        found = cells.near_cells(leaves.select("cell", "low", "high", F.lit(2 / np.sqrt(n)).alias("bound")), levels, [])
        pairs[n] = found.count()
        assert pairs[n] <= 14 * count
    assert pairs[8000] <= 6 * pairs[2000]


def test_inverted_lists(vectors):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * 3
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    x[:200] = x[0]  # one hot vector
    df = vectors(x)
    for metric in ("cosine", "euclidean"):
        exact = cut(neighbours.knn_graph(df, 10, metric))
        found = neighbours.knn_graph(df, 10, metric, search=inverted.probing(probes=8), tile_rows=128)
        score = inverted.recall(found, exact).agg(F.sum("found") / F.sum("n")).first()[0]
        assert score >= 0.9
        every = neighbours.knn_graph(df, 10, metric, search=inverted.probing(probes=5, cells=5, rounds=2), tile_rows=128)
        whole = inverted.recall(every, exact).collect()
        assert all(r["recall"] == 1.0 for r in whole) and len(whole) == 10
    near = dict(df.sparkSession.createDataFrame(found.select("idx_global", "neighbour", "dist").limit(200).collect()).rdd.map(
        lambda r: ((r[0], r[1]), r[2])).collect())
    assert all(abs(np.linalg.norm(x[a].astype(float) - x[b]) - d) < 1e-5 for (a, b), d in near.items())


def test_inverted_lists_of_small_tables(vectors):
    few = vectors([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]])
    assert neighbours.knn_graph(few, 5, "cosine", search=inverted.probing()).count() == 6
    assert neighbours.knn_graph(few.where("false"), 5, search=inverted.probing()).count() == 0


def brute_best(stability, parent):
    children = {}
    for c, p in parent.items():
        children.setdefault(p, []).append(c)
    best = {}
    for c in sorted(parent, reverse=True):  # a child has the larger number
        below = sum(best[d] for d in children.get(c, []))
        best[c] = below if parent[c] is None else max(stability[c], below) if c in children else stability[c]
    wins = {c: parent[c] is not None and (c not in children or stability[c] >= sum(best[d] for d in children[c])) for c in parent}
    chosen = set()
    for c in parent:
        p = parent[c]
        while p is not None and not wins[p]:
            p = parent[p]
        if wins[c] and p is None:
            chosen.add(c)
    return best, chosen


def tree(spark, parent, stability):
    data = [(0, c, p, float(stability[c]), 1.0, 1.0, p is None) for c, p in parent.items()]
    return spark.createDataFrame(data, "g int, cluster long, parent long, stability double, death_t double, birth_t double, root boolean")


@pytest.mark.parametrize("seed,shape", [(0, "random"), (1, "random"), (2, "path"), (3, "deep"), (4, "one")])
def test_selection_equals_brute_force(spark, seed, shape):
    r = np.random.default_rng(seed)
    n = 1 if shape == "one" else 150
    up = {"random": lambda c: int(r.integers(0, c)), "path": lambda c: c - 1, "deep": lambda c: max(0, c - int(r.integers(1, 4))), "one": None}[shape]
    parent = {0: None, **{c: up(c) for c in range(1, n)}}
    stability = {c: float(r.integers(0, 40)) / 4 for c in range(n)}
    best, chosen = brute_best(stability, parent)
    clusters = tree(spark, parent, stability)
    got, _ = density.best_below(clusters, ["g"])
    assert {x["cluster"]: x["best"] for x in got.collect()} == best
    assert {x["cluster"] for x in density._excess_of_mass(clusters, ["g"]).collect()} == chosen


def test_a_chain_of_ten_thousand_merges_takes_few_rounds(spark):
    spine = 10_000
    parent = {0: None, **{c: c - 1 for c in range(1, spine)}, **{spine + c: c for c in range(spine)}}
    stability = {c: (c * 7919) % 101 for c in parent}
    got, rounds = density.best_below(tree(spark, parent, stability), ["g"])
    order = {spine + c: c + 0.5 for c in range(spine)}
    best, below = {}, {}
    for c in sorted(parent, key=lambda c: -order.get(c, c)):
        own = stability[c] if c not in below else max(stability[c], below[c])
        best[c] = below[c] if parent[c] is None else own
        if parent[c] is not None:
            below[parent[c]] = below.get(parent[c], 0) + best[c]
    assert rounds <= 20
    assert {x["cluster"]: x["best"] for x in got.collect()} == best
