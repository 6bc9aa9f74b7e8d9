"""Properties of graph, vector, text and layout operators on small inputs, checked by brute force."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithic.functions import text as X
from lithic.functions import vectors as V
from lithic.operators import layout as L
from lithic.operators import search as S
from lithic.operators import traverse as G
from lithic.operators import versioning as N


def closure(edges):
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    changed = True
    while changed:
        changed = False
        for a in reach:
            more = set().union(*(reach.get(b, set()) for b in reach[a])) - reach[a]
            if more:
                reach[a] |= more
                changed = True
    return reach


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(7)
    edges = sorted({(rnd.randrange(24), rnd.randrange(24)) for _ in range(34)})
    edges = [(a, b) for a, b in edges if a != b]
    return edges, spark.createDataFrame(edges, "src bigint, dst bigint").cache()


def test_strong_components_equal_mutual_reachability(graph):
    edges, df = graph
    r = closure(edges)
    want = {}
    for a in r:
        group = {b for b in r[a] if a in r.get(b, set())} | {a}
        if len(group) > 1:
            want[a] = min(group)
    assert {x["id"]: x["component"] for x in G.strong_components(df).collect()} == want


def test_components_by_brute_force(graph):
    edges, df = graph
    both = [(a, b) for a, b in edges] + [(b, a) for a, b in edges]
    r = closure(both)
    assert {x["id"]: x["component"] for x in G.components(df).collect()} == {a: min(r[a] | {a}) for a in r}


def test_pagerank_sums_to_one(graph):
    assert abs(G.pagerank(graph[1]).agg(F.sum("rank")).first()[0] - 1) < 1e-9


def test_reach_is_monotone_and_complete(spark, graph):
    edges, df = graph
    seed = spark.createDataFrame([(edges[0][0], edges[0][0])], "seed bigint, node bigint")
    full = {r["node"] for r in G.reach(df, seed).collect()}
    near = {r["node"] for r in G.reach(df, seed, 1).collect()}
    assert near <= full == closure(edges)[edges[0][0]] | {edges[0][0]}


def test_layers_and_dag(spark):
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 3)], "src int, dst int")
    assert {r["id"]: r["layer"] for r in G.layers(dag).collect()} == {1: 0, 4: 0, 2: 1, 3: 2}
    assert G.is_dag(dag) and not G.is_dag(spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int"))


def test_layout_places_every_node_apart(spark, graph):
    _, df = graph
    nodes = G.nodes_of(df).withColumn("r", F.lit(8.0))
    pos = L.layout(nodes, df)
    assert pos.count() == nodes.count() and pos.filter("isnan(x) or isnan(y)").isEmpty()
    again = {(r["id"], round(r["x"], 6), round(r["y"], 6)) for r in L.layout(nodes, df).collect()}
    assert again == {(r["id"], round(r["x"], 6), round(r["y"], 6)) for r in pos.collect()}
    m = L.metrics(pos, G.clean_edges(df)).first()
    assert m["crossings"] >= 0 and m["overlaps"] >= 0


def test_crossing_count(spark):
    pos = spark.createDataFrame([(1, 0.0, 0.0, 8.0), (2, 100.0, 100.0, 8.0), (3, 0.0, 100.0, 8.0), (4, 100.0, 0.0, 8.0)], "id int, x double, y double, r double")
    e = spark.createDataFrame([(1, 2), (3, 4)], "src int, dst int")
    assert L.metrics(pos, e).first()["crossings"] == 1
    assert L.metrics(pos, spark.createDataFrame([(1, 3), (2, 4)], "src int, dst int")).first()["crossings"] == 0


def test_vectors_agree_with_the_literal_query(spark):
    words = "User42 payroll_run v2beta x payroll"
    df = spark.createDataFrame([(1, "t", "l", "r", words), (2, "t", "l", "r", "nothing else")], "id int, type string, label string, ref string, text string")
    got = df.filter("id = 1").select(V.count_map(V.buckets(F.col("text")))).first()[0]
    assert got == V.query_counts(words)
    top = S.semantic_search(df, words).collect()
    assert [(r["id"], r["score"]) for r in top] == [(1, 1.0)]
    assert spark.range(1).select(V.fnv1a(F.lit("payroll")) % 512, V.fnv1a(F.lit("user")) % 512).first()[:] == (410, 242)


def test_embedding_weights_are_unit_length(spark):
    df = spark.createDataFrame([(1, "t", "l", "r", "a1b2 some words some")], "id int, type string, label string, ref string, text string")
    assert abs(S.embedding_index(df).agg(F.sum(F.col("weight") ** 2)).first()[0] - 1) < 1e-12


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.title_case(F.lit("foo-bar éBAZ qux"))) == "Foo-Bar éBAZ Qux"
    assert one(X.normalise_path(F.lit("a/b/../../../c/./d"))) == "c/d"
    assert one(X.redact(F.lit("short"))) == "sho***" and one(X.redact(F.lit("longersecret"))) == "longer***ret"
    assert one(X.js_round(F.lit(2.5))) == 3.0 and one(X.js_round(F.lit(-2.5))) == -2.0
    assert one(X.extension(F.lit("a/.env"))) == "" and one(X.extension(F.lit("a/b.test.ts"))) == ".ts"
    assert one(X.normalise_repo_url(F.lit("git@github.com:o/r.git"))) == "https://github.com/o/r.git"
    assert one(X.normalise_repo_url(F.lit("https://github.com/o/r/tree/main/x"))) == "https://github.com/o/r.git"
    assert one(X.normalise_repo_url(F.lit("./local"))) is None
    assert one(X.repo_dir_name(F.lit("https://github.com/o/r.git"))).startswith("o__r-")


def test_diff_is_symmetric(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "path string, hash string")
    b = spark.createDataFrame([("y", "2"), ("z", "1")], "path string, hash string")
    ab = {r["path"]: r["status"] for r in N.diff_snapshots(a, b).collect()}
    ba = {r["path"]: r["status"] for r in N.diff_snapshots(b, a).collect()}
    flip = {"added": "deleted", "deleted": "added"}
    assert {k: flip.get(v, v) for k, v in ab.items()} == ba


def test_global_ordinal_counts_through(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v int").repartition(5)
    got = [(r["v"], r["i"]) for r in N.global_ordinal(df, ["v"]).collect()]
    assert sorted(got) == [(i, i) for i in range(1000)]
    assert N.sample_evenly(df, ["v"], 24).count() == 26


def test_buckets_of_odd_texts(spark):
    """Hashed over whole batches, as many numbers per text as it has buckets, and the same as hashing text by text."""
    odd = ["", "a", "a1", "1a1a1 a1", "x" * 30 + " " + "x" * 31, "é1é abİcÅK9z", "ab\x00cd", "tail7", "7head", "word " * 5000, "a1" * 15 + " " + "a1" * 16, "中文ab"]
    rows = [(i, t) for i, t in enumerate([*odd, None, *odd[::-1]])]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r["id"]: r for r in df.select("id", V.buckets(F.col("text")).alias("b"), V.squared_norm(V.buckets(F.col("text"))).alias("q")).collect()}
    for i, t in rows:
        if t is None:
            assert got[i]["b"] is None and got[i]["q"] is None
            continue
        want = V.query_counts(t)
        assert {r["bucket"]: r["n"] for r in got[i]["b"]} == want and [r["bucket"] for r in got[i]["b"]] == sorted(want)
        assert got[i]["q"] == sum(n * n for n in want.values())
    slices = V.SLICE_BYTES
    try:
        V.SLICE_BYTES = 7  # texts looked at one by one give the same
        lowered = pa.array([t if t is None else t.lower() for _, t in rows]).slice(2)
        alone = V._bucket_counts.func(lowered).to_pylist()
    finally:
        V.SLICE_BYTES = slices
    assert alone == V._bucket_counts.func(lowered).to_pylist()
    assert [x is None for x in alone] == [t is None for _, t in rows[2:]]
