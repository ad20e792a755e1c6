import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vectorlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="vectorlens-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors_frame(spark):
    """Build ``(uuid, emb)`` from a matrix."""

    def make(matrix, ids=None):
        rows = [
            (ids[i] if ids is not None else i, None if row is None else [float(v) for v in row])
            for i, row in enumerate(matrix)
        ]
        kind = "string" if ids is not None and isinstance(ids[0], str) else "long"
        return spark.createDataFrame(rows, f"uuid {kind}, emb array<float>")

    return make


@pytest.fixture(scope="session")
def many_points():
    return np.random.default_rng(2024).normal(0.2, 1.5, (96, 180)).astype(np.float32)


@pytest.fixture(scope="session")
def few_points():
    return np.random.default_rng(77).uniform(-2.0, 3.0, (10, 21)).astype(np.float32)


@pytest.fixture(scope="session")
def mixed(spark):
    """Twenty rows of mixed metadata, a five-row pattern four times over."""
    pattern = [
        ("cat", "felidae", 4.5, "healthy"),
        ("dog", "canidae", 25.0, "large breed"),
        ("cat", "felidae", 3.8, "kitten"),
        ("bird", "passeridae", 0.03, "sparrow"),
        ("dog", "canidae", 30.0, "retriever"),
    ]
    rows = [(f"uuid-{i:04d}", *pattern[i % 5], [0.1] * 8) for i in range(20)]
    return spark.createDataFrame(
        rows, "uuid string, species string, family string, weight double, notes string, emb array<float>"
    )


@pytest.fixture(scope="session")
def blobs():
    """Three well separated groups of directions, 60 rows."""
    random = np.random.RandomState(7)
    centers = np.eye(12)[:3] * 10
    labels = np.repeat([0, 1, 2], 20)
    return (centers[labels] + random.randn(60, 12) * 0.4).astype(np.float32), labels
