"""Call resolution through imports: right results, and rows that are not multiplied by names times imports."""

from lithic.operators import resolve


def _shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    none, quantiles = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_names_and_imports_are_not_multiplied(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size
    n = 100
    functions = [(f"d{j}::n{(j * n + i) % 5000}#1", f"d{j}", f"n{(j * n + i) % 5000}", (j * 37) % 101 * n + i) for j in range(n) for i in range(n)]
    calls = [(f"a{j}::c", f"a{j}", f"n{(j * 131 + i * 61) % 5000}") for j in range(n) for i in range(n)]
    imports = [(f"a{j}", f"d{(j + 3 * i) % n}") for j in range(n) for i in range(n // 2)]
    seen, first = {}, {}
    for fid, file, name, ord_ in functions:
        first[file, name] = min(first.get((file, name), (ord_, fid)), (ord_, fid))
    for file, target in imports:
        seen.setdefault(file, set()).add(target)
    expected = set()
    for caller, file, name in calls:
        found = [first[t, name] for t in seen[file] if (t, name) in first]
        if found:
            expected.add((caller, min(found)[1]))
    before = _shuffled(spark)
    got = resolve.resolve_calls(
        spark.createDataFrame(calls, "caller_id string, file string, name string"),
        spark.createDataFrame(functions, "id string, file string, name string, ord bigint"),
        spark.createDataFrame(imports, "file string, resolved string"),
    ).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {(r.src, r.dst) for r in got} == expected and len(got) == len(expected)
    assert _shuffled(spark) - before < 150_000


def test_a_unique_name_an_own_function_and_an_import(spark):
    functions = [("f::u#1", "f", "u", 1), ("f::s#2", "f", "s", 2), ("g::s#1", "g", "s", 3), ("h::s#1", "h", "s", 0), ("h::h#9", "h", "h", 9)]
    calls = [("f::u#1", "f", "s"), ("f::u#1", "f", "u"), ("k::x#1", "k", "u"), ("k::x#1", "k", "s"), ("m::x#1", "m", "s"), ("m::x#1", "m", "none")]
    got = resolve.resolve_calls(
        spark.createDataFrame(calls, "caller_id string, file string, name string"),
        spark.createDataFrame(functions, "id string, file string, name string, ord bigint"),
        spark.createDataFrame([("k", "g"), ("k", "h"), ("k", "h"), ("k", None)], "file string, resolved string"),
    ).collect()
    assert sorted(map(tuple, got)) == [("f::u#1", "f::s#2"), ("k::x#1", "f::u#1"), ("k::x#1", "h::s#1")]
