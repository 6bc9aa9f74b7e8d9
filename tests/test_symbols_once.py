"""Costly expressions of a function's record are computed once a match."""

from lithic.operators import symbols


def test_body_of_a_function_is_cut_out_once(spark):
    text = "// adds\nasync function add(a) {\n  return sum(a);\n}\nconst inc = (a) => plus(a);\n"
    files = spark.createDataFrame([("a.js", "javascript", None, text, len(text))], "path string, lang string, meta string, text string, size bigint")
    found = symbols.functions(symbols.parse(files))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("slice(code_lines") == 1
    rows = {r["name"]: r for r in found.collect()}
    add, inc = rows["add"], rows["inc"]
    assert (add["line"], add["end_line"], add["calls"], add["doc"], add["async"]) == (2, 4, ["sum"], "adds", True)
    assert (inc["line"], inc["end_line"], inc["calls"], inc["doc"], inc["async"]) == (5, 5, ["plus"], None, False)
