"""Ordinary source that is not tidy: odd encodings, very long and deeply nested statements, equal names."""

import os

from lithic.functions import blocks
from lithic.operators import deep, symbols, trace
from lithic.operators import traverse as G
from lithic.sources import tree
from lithic.sources.tree import classify


def model(spark, files):
    df = spark.createDataFrame([(k, len(v), v) for k, v in files.items()], "path string, size bigint, text string")
    return deep.model(symbols.parse(classify(df)))


def test_tree_survives_encodings_and_skips_folders(spark, tmp_path):
    root = tmp_path / "build" / "my repo+1"
    for name, data in {"a.py": "x = '\xe9'\n".encode("latin-1"), "b.py": b"ok = 1\x00", "src/c.py": "é = 1\n".encode(), "node_modules/m/d.py": b"no = 1\n", "pic.png": b"\x89PNG"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "big.py").write_bytes(b"#" * (tree.MAX_FILE_BYTES + 1))
    got = {r.path: r.text for r in tree.read_tree(spark, str(root)).collect()}
    assert got == {"a.py": "x = '\ufffd'\n", "src/c.py": "é = 1\n"}
    # nothing that is left out is opened: their content is gone and the scan does not notice
    frame = tree.read_tree(spark, str(root))
    for name in ("node_modules/m/d.py", "pic.png", "big.py"):
        os.remove(root / name)
    assert frame.count() == 2


def test_calls_nest_and_stretch_without_limit():
    names = [c["name"] for c in blocks.calls("".join(f"f{i}(" for i in range(30)) + "1" + ")" * 30)]
    assert names == [f"f{i}" for i in range(30)]
    long = blocks.calls("run(" + ",".join("a" * 9 for _ in range(10_000)) + ")")
    assert len(long) == 1 and len(long[0]["args"]) == 10_000
    assert blocks.calls("this.next.net(a ? g(x, 1) : 'f(', {k: v})")[0] == {"receiver": "next", "name": "net", "args": ["a ? g(x, 1) : 'f('", "{k: v}"]}
    assert blocks.calls("a." * 50_000) == [] and blocks.calls("q" * 200_000) == []


def test_long_statement_does_not_stop_the_job(spark):
    java = "class S {\n  int net(int a) {\n    int b = call(" + ", ".join(f"g{i}(a)" for i in range(20_000)) + ");\n    return b * a;\n  }\n}\n"
    m = model(spark, {"a/S.java": java})
    assert m.calls.count() == 20_001 and m.returns.select("op.op").first()[0] == "×"


def test_long_heads_keep_their_parameters(spark):
    java = "package p;\n@Service\nclass A\n" + "".join(f"  // {i}\n" for i in range(15)) + "  implements B {\n  int net(\n" + ",\n".join(f"    int p{i}" for i in range(14)) + ") {\n    return p13;\n  }\n}\n"
    m = model(spark, {"p/A.java": java})
    assert [r.name for r in m.params.orderBy("i").collect()] == [f"p{i}" for i in range(14)]
    assert m.classes.filter("name = 'A'").first()["implements"] == ["B"]
    names = ", ".join(f"name{i}" for i in range(40))
    df = spark.createDataFrame([("w/a.ts", 1, f"import {{ {names} }} from './far';\n")], "path string, size bigint, text string")
    assert symbols.imports(symbols.parse(classify(df))).first()["source"] == "./far"


def test_calls_of_equal_names_and_untyped_values(spark):
    files = {f"{d}/index.ts": "export function run(x: number) {\n  return x;\n}\n" for d in "pqr"}
    files["p/main.ts"] = "import { run } from './index';\nimport { Service } from './service';\nexport function go({ a, b: c }: Props, z: number) {\n  const s = new Service();\n  const t = s.work(a);\n  const u = find({ where: { id: c } });\n  return run(t);\n}\n"
    files["p/service.ts"] = "export class Service {\n  work(x: number) {\n    return x;\n  }\n}\n"
    files["q/service.ts"] = "export class Other {\n  work(x: number) {\n    return x;\n  }\n}\n"
    m = model(spark, files)
    edges = {(r.caller.split("#")[1].split("(")[0], r.callee.split(":")[1].split("(")[0]) for r in trace.call_edges(m).collect()}
    assert ("go", "p.index#run") in edges and not {("go", "q.index#run"), ("go", "r.index#run")} & edges
    assert ("go", "p.service.Service#work") in edges and not any(c.startswith("q.service") for _, c in edges)
    go = m.params.filter("method like '%go(%'")
    assert sorted((r.i, r.name) for r in go.collect()) == [(0, "a"), (0, "c"), (1, "z")]
    flow = {r.dst.split("::")[1] for r in trace.TraceModel.build(m).flow.filter("src like '%go(%::u'").collect()}
    assert "c" in flow and not flow & {"where", "id"}


def test_deep_trees(spark):
    tree_ = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id long, parent long")
    assert G.ancestors(tree_).filter("id = 39").count() == 40


def test_nearest_prefers_the_same_line(spark):
    left = spark.createDataFrame([(1, 10), (1, 30), (1, 90)], "k int, at int")
    right = spark.createDataFrame([(1, 10), (1, 14), (1, 27), (1, 33)], "k int, near int")
    got = {(r["at"], r["near"]) for r in deep.attach_nearest(left, right, ["k"], "at", "near", 6).collect()}
    assert got == {(10, 10), (30, 33)}
