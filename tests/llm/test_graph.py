"""Components against a plain search."""

import random

import pytest

from quillstone.llm.graph import components


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = start
                    todo += near[x]
    return out


RNG = random.Random(11)
SHUFFLED = RNG.sample(range(60), 60)
GRAPHS = {
    "chain": list(zip(range(40), range(1, 41), strict=True)),
    "tangled chain": list(zip(SHUFFLED, SHUFFLED[1:], strict=False)),
    "star": [(7, i) for i in range(30) if i != 7] + [(100, 101)],
    "random": [(RNG.randrange(80), 100 + RNG.randrange(80)) for _ in range(70)],
    "repeated": [(1, 2), (2, 1), (1, 2), (3, 4)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    df = spark.createDataFrame(GRAPHS[name], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == brute(GRAPHS[name])


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
