"""Parts of tiles streamed to tasks, and the screen in low precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import neighbours, tiles
from kindred.session import cut


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("make", [
    lambda r, *s: r.normal(size=s), lambda r, *s: r.integers(0, 3, size=s).astype(float),
    lambda r, *s: r.normal(size=s) + 1e6, lambda r, *s: r.normal(size=s) * 1e-20, lambda r, *s: r.normal(size=s) * 1e14,
    lambda r, *s: r.normal(size=s) * np.where(r.random(s[0]) < 0.1, 1e5, 1e-5)[:, None], lambda r, *s: np.zeros(s)])
def test_screened_lists_equal_those_of_all_distances(metric, make):
    rng = np.random.default_rng(4)
    x, y = make(rng, 60, 5), make(rng, 300, 5)
    y[::7] = x[rng.integers(0, 60, size=len(y[::7]))]
    at = {"x": x, "row": np.empty(0, np.int64), "c": np.empty(0, np.int64), "d": np.empty(0), "worst": np.full(60, np.inf)}
    for start in (0, 100, 101, 200):
        stop = {0: 100, 100: 101, 101: 200, 200: 300}[start]
        neighbours._keep_near(at, y[start:stop], np.arange(start, stop), 7, metric, None)
    d = 1.0 - tiles.cosine_block(x, y) if metric == "cosine" else np.linalg.norm(x[:, None] - y[None], axis=2)
    for i in range(60):
        got = np.sort(at["d"][at["row"] == i])
        assert np.allclose(got, np.sort(d[i])[:7], rtol=1e-9, atol=1e-12 if metric == "cosine" else 0)
        assert np.allclose(d[i][at["c"][at["row"] == i]], at["d"][at["row"] == i], rtol=1e-9, atol=1e-12 if metric == "cosine" else 0)


def test_no_row_is_made_per_pair_of_tiles(spark, vectors):
    """A tile goes to a task once per part of the other side, and the pairs are met there."""
    x = np.random.default_rng(9).normal(size=(400, 4)).astype(np.float32)
    rows = vectors(x).select(F.col("idx_global").alias("id"), F.col("embedding").alias("v"), (F.col("idx_global") % 40).alias("slot"))
    q, c = (cut(tiles.pack(rows, ["slot"], ["id"], "v", p), "tiles") for p in ("q_", "c_"))
    found = neighbours._search_tiles(q, c, 3, "euclidean")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.dist, r.c_rep)):
        got.setdefault(r.q_rep, []).append(r.c_rep)
    d = np.linalg.norm(x[:, None].astype(float) - x[None], axis=2)
    assert all(got[i][:3] == list(np.argsort(d[i], kind="stable")[:3]) for i in range(400))
