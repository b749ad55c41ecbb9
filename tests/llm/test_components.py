import random

from paperlake.llm.components import components


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)]
    edges += [(7, 7), (100, 120), (120, 100), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    assert got == {x: find(x) for x in list(parent)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
