"""Queries that read files, functions and imports many times join them once."""

import __spark_entry__ as entry


def test_metric_summary_reads_written_relations(spark):
    plan = entry.queries()["metric_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lineitem.parquet" not in plan
