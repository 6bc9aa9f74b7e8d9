"""Calls are found with few bytes on disk: shuffles of finished writes go, and odd parts give the rows they gave before."""

import time

from pyspark.sql import functions as F

from lithic import session
from lithic.operators import semantic
from lithic.operators.resolve import label_ends
from lithic.plans.warehouse import Warehouse


def _shuffle_files(spark) -> int:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_long_write_frees_its_shuffles(spark, monkeypatch):
    monkeypatch.setattr(session, "LONG_WRITE", 0.0)
    session.cut(spark.range(10))
    time.sleep(3)
    before = _shuffle_files(spark)
    out = session.cut(spark.range(100_000).repartition(7, F.col("id") % 1000))
    until = time.monotonic() + 30
    while _shuffle_files(spark) > before and time.monotonic() < until:
        time.sleep(1)
        session.cut(spark.range(10))  # the last plan may be held until the next one
    assert _shuffle_files(spark) <= before and out.count() == 100_000


def test_calls_of_odd_parts_and_lines(spark, tmp_path):
    part = [(0, "red bolt", "Brand#1", "TIN", 1), (0, "red bolt", "Brand#1", "TIN", 1), (1, "red bolt", "Brand#2", None, 1), (2, "red bolt", "Brand#2", None, 1)]
    spark.createDataFrame(part, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(0, 0, 1, 0.06), (0, 0, 1, 0.06), (0, 0, 1, None), (0, 0, 1, 0.0), (0, None, 1, 0.06), (0, None, 2, 0.0), (0, 0, None, 0.06), (1, 0, 1, 0.06), (2, 0, 1, 0.07), (None, 0, 1, 0.0)]
    spark.createDataFrame(lines, "l_partkey bigint, l_suppkey bigint, l_linenumber int, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    path = "tin/models/auth_0.py"
    expected = {(f"{path}::entry_0#1", path, "entry_1"), (f"{path}::entry_0#1", path, "handle_1"), (f"{path}::entry_0#1", path, None), (None, path, None), (None, None, "entry_1")}
    got = [tuple(r) for r in Warehouse(spark, str(tmp_path)).calls.collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_ends_of_calls_and_edges_of_domains(spark):
    edges = spark.createDataFrame([("a/x/f::1", "b/y/g::1"), ("a/x/f::2", "b/y/g::1"), ("a/x/f::2", "lost")], "src string, dst string")
    functions = spark.createDataFrame([("a/x/f::1", "a/x/f"), ("a/x/f::2", "a/x/f"), ("b/y/g::1", "b/y/g"), ("b/y/g::1", "b/y/g"), (None, "c")], "id string, file string")
    ends = label_ends(edges, functions.withColumnRenamed("file", "label"), "source", "target").collect()
    assert sorted(map(tuple, ends)) == [("a/x/f", "b/y/g")] * 4
    imports = spark.createDataFrame([("a/x/f", "b/y/g"), ("a/x/f", None), ("a/x/f", "a/x/h")], "file string, resolved string")
    db = spark.createDataFrame([("prisma", "t", "create", "a/x/f"), ("prisma", "t", "findMany", "a/x/f"), ("prisma", None, "create", "a/x/f")], "kind string, table string, op string, file string")
    got = {r.target: (r.verb, r["count"], r.imports, r.calls, r.reads, r.writes) for r in semantic.domain_edges(imports, edges, functions, db).collect()}
    assert got == {"dom:b/y": ("uses", 5, 1, 4, 0, 0), "table:t": ("persists", 2, 0, 0, 1, 1)}
