import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import neighbours


def brute(q, c, k, metric, q_ids, c_ids, exclude=False, q_lab=None, c_lab=None):
    q, c = np.asarray(q, np.float32).astype(float), np.asarray(c, np.float32).astype(float)
    out = {}
    for i, x in enumerate(q):
        if metric == "cosine":
            n = np.linalg.norm(x) * np.linalg.norm(c, axis=1)
            d = 1 - np.divide(c @ x, n, out=np.zeros(len(c)), where=n > 0)
        else:
            d = np.sqrt(((c - x) ** 2).sum(axis=1))
        rows = [(round(v, 9), j) for v, j, m in zip(d, c_ids, range(len(c)))
                if not (exclude and j == q_ids[i]) and (q_lab is None or q_lab[i] == c_lab[m])]
        out[q_ids[i]] = sorted(rows)[:k]
    return out


def as_dict(df, key="query_id", hit="idx_global"):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append((round(r["dist"], 9), r[hit]))
    return out


@pytest.fixture(scope="module")
def cloud():
    """Clustered points, a vector held by a third of all rows, a zero vector."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 6)) + 8 * rng.normal(size=(1, 6)) for _ in range(4)])
    hot = np.repeat(x[:1], 120, axis=0)
    return np.concatenate([x, hot, np.zeros((1, 6))]).astype(np.float32)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("pivots", [None, 9])
def test_graph_equals_brute_force(vectors, cloud, metric, pivots):
    ids = [int(i) for i in np.random.default_rng(2).permutation(len(cloud))]
    got = as_dict(neighbours.knn_graph(vectors(cloud, ids=ids), 5, metric, pivots=pivots, tile_rows=32),
                  "idx_global", "neighbour")
    assert got == brute(cloud, cloud, 5, metric, ids, ids, exclude=True)


def test_join_inside_groups(vectors, cloud):
    labels = [0 if i % 3 else i % 7 for i in range(len(cloud))]
    ids = list(range(len(cloud)))
    df = vectors(cloud, labels)
    got = as_dict(neighbours.knn_join(df.withColumnRenamed("idx_global", "query_id"), df, 4, "cosine",
                                      by="label", tile_rows=32))
    assert got == brute(cloud, cloud, 4, "cosine", ids, ids, q_lab=labels, c_lab=labels)


def test_fewer_rows_than_k(vectors):
    x = np.eye(3)
    got = as_dict(neighbours.knn_graph(vectors(x), 10, "euclidean"), "idx_global", "neighbour")
    assert {k: len(v) for k, v in got.items()} == {0: 2, 1: 2, 2: 2}


def test_ties_go_to_the_lower_id(vectors):
    x = [[1, 0], [0, 1], [1, 0]]
    df = vectors(x, ids=[6, 3, 21869])
    q = vectors([[1, 0.1]]).withColumnRenamed("idx_global", "query_id")
    got = neighbours.global_topk(q.drop("label"), df, 3).orderBy("rank").collect()
    assert [r.idx_global for r in got] == [6, 21869, 3]
    assert got[0].similarity == got[1].similarity


def test_group_topk_gives_relative_index_and_no_rows_for_an_empty_group(vectors):
    df = vectors([[1, 0], [0, 1], [1, 1]], labels=[1, 2, 2], ids=[0, 10, 20])
    q = vectors([[1, 1], [1, 1]], labels=[2, 5], ids=[7, 8]).withColumnRenamed("idx_global", "query_id")
    got = neighbours.group_topk(q, df, 10).orderBy("rank").collect()
    assert [(r.query_id, r.idx_relativo, r.idx_global) for r in got] == [(7, 1, 20), (7, 0, 10)]


def test_core_distance_and_edges(vectors, cloud):
    x = cloud[:50]
    near = neighbours.knn_graph(vectors(x), 6, "euclidean")
    core = neighbours.core_distance(near, 3)
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    kth = np.sort(d, axis=1)[:, 3]
    assert all(abs(r.core - kth[r.idx_global]) < 1e-6 for r in core.collect())
    for r in neighbours.mutual_reach(near, core).collect():
        assert r.a < r.b and abs(r.w - max(kth[r.a], kth[r.b], d[r.a, r.b])) < 1e-6


def test_knn_vote_prefers_the_majority(spark):
    hits = spark.createDataFrame([(1, 4), (1, 4), (1, 2), (2, 9), (2, 3)], "query_id long, label int")
    got = {r.query_id: (r.predicted, r.votes) for r in neighbours.knn_vote(hits).collect()}
    assert got == {1: (4, 2), 2: (3, 1)}


def test_top_n_is_limited_before_the_shuffle(vectors, cloud):
    near = neighbours.knn_graph(vectors(cloud), 3)
    assert "WindowGroupLimit" in near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in near._jdf.queryExecution().executedPlan().toString()


def test_pruning_skips_far_cells(spark, vectors, blobs):
    x, _ = blobs
    q = vectors(x).withColumnRenamed("idx_global", "query_id")
    got = as_dict(neighbours.knn_join(q, vectors(x), 3, "euclidean", pivots=12, tile_rows=16))
    ids = list(range(len(x)))
    assert got == brute(x, x, 3, "euclidean", ids, ids)


def test_held_lists_keep_no_batch():
    """What a task holds of the query tiles it has seen is theirs, not the Arrow batches they came in."""
    rng, rows, seen = np.random.default_rng(5), 256, []
    base = pa.total_allocated_bytes()

    def flat(x):
        return pa.array([x.ravel()], pa.list_(pa.float64()))

    def received(batch):
        """As a worker gets it: all columns in one buffer."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        return next(iter(pa.ipc.open_stream(sink.getvalue())))

    def batches():
        for q in range(8):
            ids = pa.array([np.arange(rows) + rows * q], pa.list_(pa.int64()))
            yield received(pa.RecordBatch.from_arrays(
                [ids, flat(rng.normal(size=(rows, 64))), ids, flat(rng.normal(size=(rows, 64)))],
                names=["q_id", "q_vec", "c_id", "c_vec"]))
            seen.append(pa.total_allocated_bytes() - base)

    out = list(neighbours._near_lists(3, "euclidean", False)(batches()))
    assert sum(b.num_rows for b in out) == 8 * rows * 3
    assert seen[-1] < 3 * seen[0]
