import random
import sys

import pytest

from arcframe.llm.components import components


@pytest.mark.parametrize("shape", ["random", "path", "star", "none", "loops"])
def test_components(spark, shape):
    rng = random.Random(8)
    n = 300
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(260)],
        "path": list(zip(p := rng.sample(range(n), n), p[1:], strict=False)),
        "star": [(5, i) for i in range(6, n)] + [(3, n - 1)],
        "none": [],
        "loops": [(1, 1), (2, 1), (1, 2)],
    }[shape]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert {r.node: r.component for r in got} == {i: root(i) for i in linked}


def test_hubs(spark, monkeypatch):
    module = sys.modules[components.__module__]
    monkeypatch.setattr(module, "FEW", 3)
    monkeypatch.setattr(module, "HUBS", 4)
    rng = random.Random(8)
    edges = [(rng.choice([0, 50]), rng.randrange(1, 50)) for _ in range(30)] + [(60 + i, 61 + i) for i in range(20)] + [(90, 90 + i) for i in range(1, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {n: c for n, c in got.items()} == {n: c for n, c in label.items() if n in got} and len(got) == len({n for a, b in edges if a != b for n in (a, b)})
