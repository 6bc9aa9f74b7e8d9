"""A component is laid out and judged the same way whatever its size."""

from pyspark.sql import functions as F

from lithic.operators import layout as L
from lithic.operators import traverse as G


def test_large_and_small_stars_get_the_same_layout(spark):
    star = lambda hub, n: [(hub, hub + i) for i in range(1, n + 1)]
    edges = spark.createDataFrame(star(0, 100) + star(1000, 300), "src bigint, dst bigint")
    pos = L.layout(G.nodes_of(edges).withColumn("r", F.lit(8.0)), edges)
    assert {(r.component, r.strategy) for r in pos.select("component", "strategy").distinct().collect()} == {(0, "radial"), (1000, "radial")}


def test_all_crossings_of_a_large_component_count(spark):
    n = 850  # three blocks
    ends = [(i, "s", 0, float(i), 0.0, 8.0) for i in range(n)] + [(n + i, "s", 0, float(n - i), 100.0, 8.0) for i in range(n)]
    pos = spark.createDataFrame(ends, "id bigint, strategy string, component bigint, x double, y double, r double")
    edges = spark.createDataFrame([(i, n + i) for i in range(n)], "src bigint, dst bigint")
    got = L.quality(pos, edges).collect()
    assert [r.crossings for r in got] == [n * (n - 1) // 2]
