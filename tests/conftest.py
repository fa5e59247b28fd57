from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from ringsight.session import build_session

    session = build_session("local[*]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def random_graph(spark):
    """A small directed multigraph with a hub, self loops, parallel edges and an isolated node."""
    import numpy as np

    from ringsight.graph import FraudGraph

    rng = np.random.RandomState(7)
    n = 40
    pairs = [(int(a), int(b)) for a, b in rng.randint(0, n - 1, size=(150, 2))]
    pairs += [(0, j) for j in range(1, 30)] + [(j, 0) for j in range(5, 35)] + [(3, 3), (4, 9), (4, 9)]
    edges = [(i, a, b, int(rng.randint(0, 4)), int(rng.randint(1, 20))) for i, (a, b) in enumerate(pairs)]
    nodes = [
        (i, *[float(round(v, 3)) for v in rng.normal(size=4)], int(rng.randint(0, 4)), ["train", "valid", "test"][i % 3])
        for i in range(n)
    ]
    graph = FraudGraph(
        spark.createDataFrame(nodes, "node_id long, f0 double, f1 double, f2 double, f3 double, label int, split string"),
        spark.createDataFrame(edges, "edge_id long, src long, dst long, edge_type int, ts int"),
    )
    return graph, nodes, edges
