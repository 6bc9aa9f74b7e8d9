"""Sizes of closures against a walk, on graphs with one successor and with several."""

import random

from lithic.operators import traverse as G


def _walk(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    sizes = set()
    for start in out:
        seen, todo = {start}, [start]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        sizes.add((start, len(seen)))
    return sizes


def _sizes(spark, edges):
    return sorted(map(tuple, G.reach_counts(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()))


def test_one_successor_each(spark, monkeypatch):
    def listed(*_):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(G, "reach", listed)
    rng = random.Random(7)
    loose = [(i, rng.randrange(400)) for i in range(300)]  # tails, cycles, ends and self loops
    ring = [(1000 + i, 1000 + (i + 7) % 40) for i in range(40)] + [(2000 + i, 2000 + i + 1) for i in range(45)]
    edges = loose + ring + [(3000, 1000), (3001, 3000), (4000, 4000)]
    assert _sizes(spark, edges + edges[:5]) == sorted(_walk(edges))


def test_several_successors(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (5, 5)]
    assert _sizes(spark, edges) == sorted(_walk(edges))
