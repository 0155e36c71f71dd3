"""Trees as edge tables: any depth and direction, in few joins."""

import numpy as np
import pytest

from dendrospark.operators import graph


@pytest.fixture
def chain(spark):
    """300 nodes in a row with a leaf at every tenth; edges of mixed direction."""
    rng = np.random.default_rng(0)
    edges = [(i, i + 1, float(i % 3 + 1)) for i in range(1, 300)] + [(i, 1000 + i, 0.5) for i in range(10, 300, 10)]
    return edges, [(b, a, w) if flip else (a, b, w) for (a, b, w), flip in zip(edges, rng.random(len(edges)) < 0.5, strict=True)]


def walk(edges, root):
    near, far = {}, {root: 0.0}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    todo = [root]
    while todo:
        v = todo.pop()
        for u, w in near[v]:
            if u not in far:
                far[u] = far[v] + w
                todo.append(u)
    return far


def test_pseudotime_of_a_deep_tree(spark, chain):
    straight, mixed = chain
    other = [(5000, 5001, 1.0), (5001, 5002, 1.0)]  # not connected with the root
    for edges, root in ((straight + other, 1), (mixed + other, 1), (mixed, 137)):
        got = graph.pseudotime(spark.createDataFrame(edges, "src long, dst long, weight double"), root)
        plan = got._jdf.queryExecution().analyzed().toString()
        assert len(plan.splitlines()) < 60  # no level of the tree adds to the plan
        assert {r.node: r.pseudotime for r in got.collect()} == walk(edges if edges is mixed else edges[: -len(other)], root)


def test_path_of_a_deep_tree(spark, chain):
    edges = spark.createDataFrame(chain[0], "src long, dst long, weight double")
    got = graph.path_to_root(edges, 1290)
    assert len(got._jdf.queryExecution().analyzed().toString().splitlines()) < 60
    assert {r.step: r.node for r in got.collect()} == {0: 1290, **{k: 291 - k for k in range(1, 291)}}
    with pytest.raises(RuntimeError):
        graph.path_to_root(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double"), 1).collect()
