"""Registered queries against their SQL on the smallest tables (a cross-section; the check tool runs all)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = """doc_semantic_search hybrid_search lexical_retrieve global_search dense_similar route_scan db_access_scan env_scan import_resolve function_extract
call_resolve reachability components table_summary centrality_rank risk_rank heat_normalised domain_cluster insight_lists snapshot_diff timeline_sample
layer_matrix co_access_pairs nearest_line_attach capability_evidence""".split()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    message, _, _, ok = check.check(spark, con, SF, name)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["id", "type", "label", "ref", "score"]
