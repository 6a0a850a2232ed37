import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kindred.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "kindred-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def vectors(spark):
    """A frame of (idx_global, embedding, label) out of a matrix."""
    def make(x, labels=None, ids=None):
        x = np.asarray(x, dtype=np.float32)
        ids = range(len(x)) if ids is None else ids
        labels = [0] * len(x) if labels is None else labels
        rows = [(int(i), [float(v) for v in row], int(lab)) for i, row, lab in zip(ids, x, labels)]
        return spark.createDataFrame(rows, "idx_global long, embedding array<float>, label int")

    return make


@pytest.fixture(scope="session")
def blobs():
    """Five Gaussians far apart, 40 rows each, and 10 uniform rows between them."""
    rng = np.random.default_rng(42)
    centres = rng.normal(size=(5, 8)) * 40
    points = [c + rng.normal(size=(40, 8)) for c in centres]
    x = np.concatenate(points + [rng.uniform(-100, 100, size=(10, 8))])
    return x, np.array([i for i in range(5) for _ in range(40)] + [-1] * 10)
