"""A plugin or a relation that fails while it runs leaves the others whole."""

from pyspark.sql import functions as F

from lithic.operators.plugins import Plugin, Registry
from lithic.sources.store import Store


def test_a_plugin_that_fails_at_run_time_is_left_out(spark):
    bad = lambda c: {"tags": c["files"].select(F.lit("n").alias("node"), F.raise_error(F.lit("broken")).cast("string").alias("tag"))}
    good = lambda c: {"tags": c["files"].select(F.col("path").alias("node"), F.lit("seen").alias("tag"))}
    files = spark.createDataFrame([("a.py",)], "path string")
    always = lambda c: True
    out = Registry([Plugin("bad", "Bad", "", always, bad), Plugin("good", "Good", "", always, good)]).run(spark, {"files": files})
    assert [tuple(r) for r in out.relations["tags"].collect()] == [("a.py", "seen")]
    assert "broken" in out.ran[0]["error"] and out.ran[1] == {"id": "good", "label": "Good"}


def test_a_relation_that_fails_is_logged(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "r")
    store.save_all({"bad": spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("x")), "good": spark.range(3).toDF("y")})
    assert store.load("good").count() == 3
    assert {r.event for r in store.history().collect()} == {"failed", "index"}
