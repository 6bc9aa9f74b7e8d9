import math
import random

from pyspark.sql import functions as F

from lithic.llm import kdtree


def slow(rows, k=10):
    good = []
    for i, (vec_id, v, _) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, vec_id, [math.floor(1024 * float(x)) for x in v]))
    out = []
    for i, q, a in good:
        if q is not None and q % 100 == 0:
            ranked = sorted((-sum(x * y for x, y in zip(a, b)), v is None, v or 0) for j, v, b in good if j != i)
            out += [(q, r + 1, None if none else v, -s) for r, (s, none, v) in enumerate(ranked[:k])]
    return sorted(out, key=str)


def check(spark, rows, shard_rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    got = kdtree.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=shard_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == slow([(a, None if b is None else [None if x is None else float(__import__("numpy").float32(x)) for x in b], c) for a, b, c in rows])


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(0, 0.3), 3) for _ in range(6)], 1) for i in range(1500)]
    rows += [(2000 + i, [0.25] * 6, 1) for i in range(400)]
    check(spark, rows, 400)
    check(spark, rows, 10_000)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (200, None, 1), (300, [float("nan"), 1.0], 1), (400, [None, 1.0], 1), (500, [float("inf")], 1), (None, [1.0], 1), (7, [], 1), (600, [1.0], 1), (9, [1.0, 1.0, 5.0], 1)]
    check(spark, rows, 3)
    check(spark, rows, 100)
    assert kdtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    check(spark, [(0, [1.0], 1)], 5)


def test_large_components_stay_exact(spark):
    check(spark, [(0, [3.0e5, 1.5e5], 1), (1, [2.99e5, 1.49e5], 1), (2, [2.98e5, 1.52e5], 1)], 10)
