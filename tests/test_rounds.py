"""Loops over graphs where no node has more than one successor take rounds by the logarithm of the length, with the results of a walk."""

import random

import pytest

from lithic.operators import traverse as G


@pytest.fixture
def writes(monkeypatch):
    """How many tables the loops write."""
    seen, real = [], G.cut_observed

    def counted(df, **metrics):
        seen.append(1)
        return real(df, **metrics)

    monkeypatch.setattr(G, "cut_observed", counted)
    monkeypatch.setattr(G, "cut", lambda df: counted(df)[0])
    monkeypatch.setattr(G, "cut_counted", lambda df: (lambda out, got: (out, got["n"]))(*counted(df)))
    return seen


def _graph():
    rng = random.Random(3)
    loose = {i: rng.randrange(300) for i in range(250)}
    ring = {1000 + i: 1000 + (i + 7) % 60 for i in range(60)}
    path = {2000 + i: 2000 + i + 1 for i in range(60)} | {3000: 1000}
    return loose | ring | path


def test_cycles_by_doubling(spark, writes):
    to = _graph()
    want = set()
    for start in to:
        met, at = [], start
        while at in to and at not in met:
            met.append(at)
            at = to[at]
        cycle = met[met.index(at) :] if at in met else []
        if len(cycle) > 1:
            want |= {(m, min(cycle)) for m in cycle}
    got = G.strong_components(spark.createDataFrame(list(to.items()) + [(4000, 4000)], "src bigint, dst bigint"))
    assert set(map(tuple, got.collect())) == want
    assert len(writes) < 50


def test_reach_by_doubling(spark, writes):
    to, seeds = _graph(), [("a", 2000), ("a", 5), ("b", 3000), ("c", 77), ("d", 9999)]
    want = {}
    for seed, at in seeds:
        depth, met = 0, set()
        while at is not None and at not in met:
            met.add(at)
            want[seed, at] = min(depth, want.get((seed, at), depth))
            at, depth = to.get(at), depth + 1
    got = G.reach(spark.createDataFrame(list(to.items()), "src bigint, dst bigint"), spark.createDataFrame(seeds, "seed string, node bigint"))
    assert {(r.seed, r.node): r.depth for r in got.collect()} == want
    assert len(writes) < 25


def test_layers_and_depths_by_doubling(spark, writes):
    rng = random.Random(5)
    to = _graph() | {4000 + i: 4000 + i + 1 for i in range(300)} | {5000 + i: 5000 + i // 2 for i in range(1, 40)}
    edges = spark.createDataFrame([(a, b) for a, b in to.items()], "src long, dst long")
    to = {a: b for a, b in to.items() if a != b}
    nodes, before, near = {*to, *to.values()}, {}, {}
    for a, b in to.items():
        before.setdefault(b, []).append(a)
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    layer, open_ = {}, set(nodes)
    while ready := [n for n in open_ if all(p in layer for p in before.get(n, []))]:
        layer |= {n: max((layer[p] + 1 for p in before.get(n, [])), default=0) for n in ready}
        open_ -= set(ready)
    centres, want, seen = [9999], {9999: 0}, set()
    for start in sorted(nodes, key=lambda n: rng.random()):
        if start not in seen:
            centres.append(start)
            front, depth = [start], 0
            while front:
                want |= dict.fromkeys(front, depth)
                seen |= set(front)
                front, depth = list({b for a in front for b in near[a]} - seen), depth + 1
    assert max(layer.values()) >= 300 and max(want.values()) >= 100
    got = {r["id"]: r["layer"] for r in G.layers(edges).collect()}
    assert got == layer
    first = len(writes)
    rows = G.centre_depth(edges, spark.createDataFrame([(c,) for c in centres], "id long")).collect()
    assert {r["id"]: r["depth"] for r in rows} == want and len(rows) == len(want)
    assert first < 60 and len(writes) - first < 80, "a round a step would write more than 300 tables"
