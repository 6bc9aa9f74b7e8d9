"""The whole analysis over a mini source tree, the catalog on disk, and incremental updates."""

import pytest
import tree_fixture
from pyspark.sql import functions as F

from lithic.operators import impact
from lithic.plans.analyze import Analysis
from lithic.sources import manifests, tree
from lithic.sources.store import Store
from lithic.streaming import reindex


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return tree_fixture.write(tmp_path_factory.mktemp("tree"))


@pytest.fixture(scope="module")
def found(spark, root):
    return Analysis.of_tree(spark, root)


def col(df, *names):
    return {tuple(r) if len(names) > 1 else r[0] for r in df.select(*names).collect()}


def test_walk_skips_ignored_and_binary(spark, root):
    paths = col(tree.read_tree(spark, root), "path")
    assert "src/main.py" in paths and not any("node_modules" in p or p.endswith(".png") for p in paths)
    s = tree.skip_counts(tree.listing(spark, root)).first()
    assert (s["binary"], s["too_big"], s["ignored_dir"]) == (1, 0, 1)


def test_functions(found):
    got = {r["name"]: (r["file"], r["line"], r["complexity"]) for r in found.functions.collect()}
    assert got["place"] == ("src/service/orders.py", 5, 3)
    assert got["total"][1] == 2 and got["twice"][1] == 5
    doc = found.functions.filter("name = 'total'").first()["doc"]
    assert doc == "Adds."


def test_imports_resolve(found):
    got = col(found.imports.filter("resolved is not null"), "file", "resolved")
    assert ("src/main.py", "src/service/orders.py") in got
    assert ("src/service/orders.py", "src/model/order.py") in got
    assert ("src/pages/cart.tsx", "src/utils/sum.ts") in got
    assert ("tests/test_orders.py", "src/service/orders.py") in got


def test_calls_and_cycle(found):
    edges = {(a.split("::")[1].split("#")[0], b.split("::")[1].split("#")[0]) for a, b in col(found.call_edges, "src", "dst")}
    assert {("main", "place"), ("place", "save_order"), ("Cart", "total"), ("test_place", "place")} <= edges
    assert col(found.cycles, "id") == {"src/service/orders.py", "src/model/order.py"}


def test_signals(found):
    assert ("GET", "/orders") in col(found.routes, "method", "path")
    assert {("ddl-table", "orders"), ("sql", "orders"), ("sql", "staging"), ("django-orm", "Order")} <= col(found.db_access, "kind", "table")
    assert col(found.env, "name") == {"ORDER_KEY"}
    hit = found.security.filter("type = 'secret'").first()
    assert hit["kind"] == "Hardcoded credential" and hit["snippet"] == "token ***78'"
    assert col(found.infra, "system") == {"docker"}


def test_dependencies(spark, found):
    got = col(found.dependencies, "ecosystem", "name", "scope")
    assert got == {
        ("npm", "express", "runtime"), ("npm", "vitest", "dev"), ("pip", "requests", "runtime"), ("pip", "flask", "runtime"), ("go", "github.com/a/b", "runtime"),
    }
    version = {r["name"]: r["version"] for r in found.dependencies.collect()}
    assert version["requests"] == ">=2.0" and version["flask"] == "*"
    text = spark.createDataFrame([("Cargo.toml", "[dependencies]\nserde = \"1\"\n[dev]\nx = \"1\"\n"), ("Gemfile", "gem 'rails'\n"), ("pom.xml", "<artifactId>core</artifactId>")], "path string, text string")
    assert col(manifests.dependencies(manifests.manifests(text)), "name") == {"serde", "rails", "core"}


def test_quality_and_capabilities(found):
    s = found.summary.first()
    assert s["circular"] == 1 and s["dead"] >= 1
    assert {r["key"] for r in found.health.collect()} >= {"overall", "testing"}
    assert "payments" in col(found.capabilities, "id")


def test_impact_of_file(found):
    row = impact.impact_of_file(found.imports, found.functions, found.call_edges, found.routes, found.db_access, "src/model/order.py").first()
    assert row["files"] == 3 and row["tests"] == 1 and row["severity"] == "medium"


def test_request_trace(found):
    steps = impact.trace_request(found.routes, found.functions, found.call_edges, found.db_access, found.files, "GET", "/orders")
    kinds = [r["kind"] for r in steps.orderBy("ord").collect()]
    assert kinds[0] == "client" and kinds[-1] == "response" and "route" in kinds


def test_store_roundtrip(spark, found, tmp_path):
    store = Store(spark, str(tmp_path), "r1")
    store.save_all({"routes": found.routes})
    assert store.load("routes").count() == found.routes.count()
    assert store.history().count() == 1
    store.memo_put(spark.createDataFrame([(["a", "b"], "why")], "parts array<string>, text string"))
    store.memo_put(spark.createDataFrame([(["a", "b"], "again")], "parts array<string>, text string"))
    assert store.memo_get(["a", "b"]) == "why" and store.memo_list().count() == 1
    assert store.memo_clear() == 1 and store.memo().isEmpty()
    assert store.ensure("x", lambda: spark.range(3)).count() == 3


def test_reindex_parses_only_changes(spark, root, tmp_path):
    store = Store(spark, str(tmp_path), "r2")
    files = tree.read_tree(spark, root).select("path", "size", "text", "content")
    first = reindex.reindex(store, files)
    assert first["added"] == files.count() and first["modified"] == 0
    assert reindex.reindex(store, files)["changed"] == 0
    edited = files.withColumn("text", F.when(F.col("path") == "src/main.py", "def other():\n    pass\n").otherwise(F.col("text")))
    edited = edited.withColumn("content", F.encode("text", "UTF-8")).filter("path <> 'src/utils/orphan.ts'")
    third = reindex.reindex(store, edited)
    assert (third["added"], third["modified"], third["deleted"]) == (0, 1, 1)
    names = col(store.load("functions"), "name")
    assert "other" in names and "main" not in names and "unusedHelper" not in names and "place" in names


def test_stream_merges_newest_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "r3")
    src = str(tmp_path / "in")
    row = lambda name, at: ("a.py", 10, f"def {name}():\n    pass\n", at)
    write = lambda rows: spark.createDataFrame(rows, "path string, size bigint, text string, at string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(src)
    write([row("one", "2024-01-01 00:00:00"), row("two", "2024-01-01 00:10:00")])
    reindex.watch(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    assert col(store.load("functions"), "name") == {"two"}
    write([row("three", "2024-01-01 00:20:00")])
    reindex.watch(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    assert col(store.load("functions"), "name") == {"three"} and store.load("hashes").count() == 1


def test_stream_ignores_late_versions_and_drops_deleted_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "r4")
    src = str(tmp_path / "in")

    def arrive(*rows):
        full = [(p, 10, None if name is None else f"def {name}():\n    pass\n", at) for p, name, at in rows]
        spark.createDataFrame(full, "path string, size bigint, text string, at string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(src)
        reindex.watch(spark, src, store, str(tmp_path / "cp"), "10 days").awaitTermination()
        return col(store.load("functions"), "name")

    assert arrive(("a.py", "new", "2024-01-02 00:00:00"), ("b.py", "other", "2024-01-02 00:00:00")) == {"new", "other"}
    assert arrive(("a.py", "old", "2024-01-01 00:00:00")) == {"new", "other"}
    assert arrive(("b.py", None, "2024-01-03 00:00:00")) == {"new"}
    assert arrive(("b.py", "late", "2024-01-02 12:00:00")) == {"new"} and "b.py" not in col(store.load("files"), "path")
