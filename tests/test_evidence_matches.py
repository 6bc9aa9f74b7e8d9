"""Evidence matches against a plain count, and each shared text looked at once."""

from lithic.functions import taxonomy as T
from lithic.operators import capability as C


def _caps(rows):
    base = T.built_in()[0]
    return [base.__class__(**{**base.__dict__, "id": name, "needles": {s: words for s in T.SIGNALS}}) for name, words in rows]


CAPS = _caps([("pay", ["Pay", "bill", "payment"]), ("mail", ["mail", "e", "e"]), ("both", ["bill", "mail"])])


def _frames(spark):
    files = spark.createDataFrame([("src/mail/pay_bill.py",), ("tests/mail.py",), ("src/none.py",)], "path string")
    functions = spark.createDataFrame([("payment", "a"), ("payment", "a"), ("PAYMENT", "b"), ("x", "c"), (None, "d")], "name string, file string")
    classes = spark.createDataFrame([("payment", "a"), ("payment", "a")], "name string, file string")
    routes = spark.createDataFrame([("GET", "/bill", "a"), ("GET", "/bill", "a"), ("PUT", "/bill", "b"), (None, "/bill", "a")], "method string, path string, file string")
    names = spark.createDataFrame([("mailer",), ("mailer",), (None,)], "name string")
    return files, functions, classes, routes, names.withColumnRenamed("name", "table"), names, names


def _plain(caps):
    def row(cap, signal, item, file, hay, equal=False):
        words = [w.lower() for w in caps[cap]]
        return (cap, signal, item, file, sum(w in hay for w in (set(words) if equal else words)))

    caps = {c: w for c, w in caps}
    out = []
    for cap in caps:
        for path, toks in (("src/mail/pay_bill.py", {"src", "mail", "pay", "bill", "pay_bill.py"}), ("tests/mail.py", {"tests", "mail", "mail.py"})):
            out.append(row(cap, "name", path, path, toks, True))
        for name, file, times in (("payment", "a", 3), ("PAYMENT", "b", 1)):  # one distinct function, two classes
            out += [row(cap, "symbol", name, file, name.lower())] * times
        out += [row(cap, "route", item, file, "/bill") for item, file in (("GET /bill", "a"), ("PUT /bill", "b"), ("/bill", "a"))]
        out += [row(cap, s, "mailer", None, "mailer") for s in ("table", "dep", "env")]
    return sorted((r for r in out if r[4]), key=repr)


def test_matches(spark, rows):
    ev = C.evidence(*_frames(spark), CAPS).select("cap", "signal", "item", "file", "hits")
    assert rows(ev) == _plain([("pay", ["Pay", "bill", "payment"]), ("mail", ["mail", "e", "e"]), ("both", ["bill", "mail"])])


def test_names_are_matched_once(spark, monkeypatch):
    """Names and route paths reach the matching as distinct texts, however many rows share them."""
    seen, real = {}, C._matches

    def watched(df, caps, signal, *rest, **kw):
        seen[signal] = max(seen.get(signal, 0), df.count())
        return real(df, caps, signal, *rest, **kw)

    monkeypatch.setattr(C, "_matches", watched)
    many = spark.range(2000).selectExpr("concat('payment', id % 3) as name", "concat('f', id) as file")
    files, _, classes, _, *rest = _frames(spark)
    C.evidence(files, many, classes, many.selectExpr("'GET' as method", "name as path", "file"), *rest, CAPS)
    assert seen["symbol"] <= 3 and seen["route"] <= 3
