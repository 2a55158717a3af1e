import random

import pytest

from cloudweave.llm import graph


@pytest.mark.parametrize("held", [1 << 19, 3])
def test_components_equal_a_plain_search(spark, held):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(170)] + [(900, 900), (500, 499), (499, 500)]
    edges += [(1000, 1001 + i) for i in range(200)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5), held).collect()}
    assert got == {x: find(x) for x in up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
