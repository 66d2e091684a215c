"""Connected components against the ones of a plain search, also where a round leaves a node with two roots."""

import random

from lodestar.llm.components import components


def least(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def found(spark, edges):
    return sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))


def test_a_node_between_two_roots(spark):
    edges = [(4, 1), (4, 3), (5, 3), (5, 2)]
    assert found(spark, edges) == [(i, 1) for i in range(1, 6)]


def test_random_paths(spark):
    rng, edges = random.Random(1), []
    for i in range(60):
        path = [100 * i + j for j in rng.sample(range(8), 8)]
        edges += zip(path, path[1:])
    assert found(spark, edges) == least(edges)
