import random

from lithic.functions import blocks
from lithic.operators import symbols


def parsed(spark, texts):
    rows = [(f"f{i}.{'py' if lang == 'python' else 'ts'}", lang, None, len(t), t) for i, (lang, t) in enumerate(texts)]
    return symbols.parse(spark.createDataFrame(rows, "path string, lang string, meta string, size long, text string"))


def test_functions_without_a_name(spark):
    text = 'app.get("/x", (req, res) => {\n  make(req)\n})\nconst kept = (a) => pack(a)\nlist.map(x => shape(x))\nrun(function () {\n  later()\n})\n'
    got = {(r.name, r.line, r.end_line, tuple(r.calls)) for r in symbols.functions(parsed(spark, [("typescript", text)])).collect()}
    assert got == {("(anonymous)", 1, 3, ("make",)), ("kept", 4, 4, ("pack",)), ("(anonymous)", 5, 5, ("shape",)), ("(anonymous)", 6, 8, ("later",))}


def test_files_with_lone_brackets(spark):
    texts = [
        ("typescript", "f(a[1], {b: 2});"), ("typescript", "f(a[1], {b: 2};"), ("typescript", "}{"), ("typescript", 'g("(((", x) // )))\n'),
        ("python", "def f(a):\n    return (a\n"), ("python", "x = [1, (2, 3)]\n"), ("typescript", ""),
    ]
    assert {r.path for r in symbols.broken(parsed(spark, texts)).collect()} == {"f1.ts", "f2.ts", "f4.py"}


def test_statements_take_time_in_proportion():
    import time

    def took(n):
        code = "type T =\n" + "".join(f"  | {{ k: 'v{i}', n: {i} }}\n" for i in range(n))
        begin = time.process_time()
        blocks.statements(code, code)
        return time.process_time() - begin

    took(500)
    assert took(40_000) < 40 * max(took(4_000), 0.01)
    code = "class A {\n" + "".join(f"  void m{i}(int a) {{ int x = a + {i}; this.y = x; }}\n" for i in range(3000)) + "}\n"
    assert len(blocks.statements(code, code)) == 6000


def test_statements_of_any_text():
    rng = random.Random(5)
    for _ in range(300):
        code = "".join(rng.choice(["if (a)", "else", "{", "}", "(", ")", ";", "\n", " ", "x = 1", "return y", "=>", "|"]) for _ in range(rng.randint(0, 40)))
        for line, text, _ in blocks.statements(code, code):
            assert text and 1 <= line <= code.count("\n") + 1 and text.strip() == text
