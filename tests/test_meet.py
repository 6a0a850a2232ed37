"""Pairs of tiles: every pair once, and no side shuffled once per tile of the other."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kindred.operators import inverted, neighbours, tiles
from kindred.session import cut


def numbered(spark, name, rows):
    return cut(spark.createDataFrame(rows, f"g int, {name} long"), name)


def test_every_pair_of_a_group_meets_once(spark):
    sizes = {0: (120, 90), 1: (1, 7), 2: (3, 0), 3: (5, 1)}
    left = numbered(spark, "a", [(g, i) for g, (n, _) in sizes.items() for i in range(n)])
    right = numbered(spark, "b", [(g, i) for g, (_, n) in sizes.items() for i in range(n)])
    met = Counter((r.g, r.a, r.b) for r in tiles.meet(left, right, ["g"], "a", "b").collect())
    assert met == Counter((g, i, j) for g, (n, m) in sizes.items() for i in range(n) for j in range(m))
    alone = tiles.meet(left.where("g = 0").drop("g"), right.where("g = 0").drop("g"), [], "a", "b", F.expr("a <= b"))
    assert Counter((r.a, r.b) for r in alone.collect()) == Counter((i, j) for i in range(120) for j in range(90) if i <= j)
    assert not tiles.meet(left, right.limit(0), ["g"], "a", "b").count()
    assert not tiles.meet(left.drop("g"), right.limit(0).drop("g"), [], "a", "b").count()


def shuffled_rows(frame):
    """Rows written by the exchanges right below the joins of tiles."""
    frame.collect()
    rows, stack = [], [frame._jdf.queryExecution().executedPlan()]
    while stack:
        plan = stack.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            stack.append(plan.executedPlan())
            continue
        if plan.nodeName().endswith("QueryStage"):
            stack.append(plan.plan())
            continue
        if plan.nodeName() == "Exchange":
            rows.append(plan.metrics().apply("shuffleRecordsWritten").value())
        stack.extend(plan.children().apply(i) for i in range(plan.children().size()))
    return sum(rows)


def test_tiles_travel_by_parts_not_by_partners(spark):
    def pairs(n):
        side = numbered(spark, "a", [(0, i) for i in range(n)])
        return shuffled_rows(tiles.meet(side, side.withColumnRenamed("a", "b"), ["g"], "a", "b"))

    few, many = pairs(60), pairs(240)
    assert many <= 4 * few and many <= 2 * 240 * 7


def test_tiles_are_never_broadcast(spark):
    """However small a written table of tiles is on disk, the driver does not collect it."""
    left, right = (numbered(spark, n, [(i % 3, i) for i in range(30)]) for n in "ab")
    for met in (tiles.meet(left, right, ["g"], "a", "b"), tiles.meet(left.drop("g"), right.drop("g"), [], "a", "b")):
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan
        assert "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()


def test_lists_over_many_tiles_keep_ties_and_order(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "HELD", 64)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(150, 4)).astype(np.float32)
    got = {}
    for r in neighbours.knn_graph(vectors(x), 6, "euclidean", tile_rows=8).collect():
        got.setdefault(r.idx_global, {})[r.rank] = r.neighbour
    for i in range(len(x)):
        d = np.linalg.norm(x - x[i], axis=1).round(9)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:6]
        assert [got[i][r] for r in range(1, 7)] == order


def test_a_query_is_stored_once_whatever_it_probes(spark, vectors, monkeypatch):
    written = {}

    def counting(df, name="cut", folders=()):
        out = cut(df, name, folders)
        written[name] = out
        return out

    monkeypatch.setattr(inverted, "cut", counting)
    x = np.random.default_rng(5).normal(size=(300, 5))
    neighbours.knn_graph(vectors(x), 3, "euclidean", tile_rows=16, search=inverted.probing(6, 12)).count()
    assert written["probes"].count() == 300


def test_a_task_sends_each_list_once():
    rng = np.random.default_rng(6)
    q, c = rng.normal(size=(4, 3)), rng.normal(size=(40, 8, 3))
    batches = [pa.RecordBatch.from_pydict({
        "g": ["a"] * 5, "q_id": [[1, 2, 3, 4]] * 5, "q_vec": [list(q.ravel())] * 5,
        "c_id": [list(range(8 * i, 8 * i + 8)) for i in range(at, at + 5)], "c_vec": [list(c[i].ravel()) for i in range(at, at + 5)],
    }) for at in range(0, 40, 5)]
    out = pa.Table.from_batches(list(neighbours._near_lists(3, "euclidean", True)(iter(batches)))).to_pylist()
    want = np.linalg.norm(q[:, None] - c.reshape(1, 320, 3), axis=2)
    assert sorted((r["q_rep"], r["c_rep"]) for r in out) == sorted((i + 1, int(j)) for i in range(4) for j in np.argsort(want[i])[:3])
