"""The timeline from validity intervals against listings of the tree, commit by commit."""

from lithic.operators import versioning as V

CHANGES = [
    ("c1", "src/a.py", False), ("c1", "src/routes.ts", False), ("c1", "db/schema.sql", False), ("c2", "src/a.py", True), ("c2", "tests/t.py", False),
    ("c3", "src/a.py", False), ("c3", "src/a.py", True), ("c3", "never/there.go", True), ("c4", "src/routes.ts", False), ("c5", "src/routes.ts", True),
    ("c5", "src/routes.ts", True), ("c6", "src/a.py", True), ("c6", "tests/t.py", True),
]
SCHEMA = "commit string, path string, deleted boolean"


def test_validity(spark, rows):
    got = rows(V.validity(spark.createDataFrame(CHANGES, SCHEMA)))
    assert got == sorted([
        ("db/schema.sql", "c1", None), ("src/a.py", "c1", "c2"), ("src/a.py", "c3", "c6"), ("src/routes.ts", "c1", "c5"), ("tests/t.py", "c2", "c6"),
    ], key=repr)


def test_counts_equal_listings(spark, rows):
    tree, listing = set(), []
    for c in ("c1", "c2", "c3", "c4", "c5", "c6"):
        here = [(p, d) for k, p, d in CHANGES if k == c]
        tree = (tree | {p for p, _ in here}) - {p for p, _ in here if all(d for q, d in here if q == p)}
        listing += [(c, p) for p in tree]
    intervals = V.validity(spark.createDataFrame(CHANGES, SCHEMA))
    for points in (["c1", "c2", "c3", "c4", "c5", "c6"], ["c2", "c5"]):
        samples = spark.createDataFrame([(c,) for c in points], "commit string")
        want = V.timeline_counts(spark.createDataFrame([r for r in listing if r[0] in points], "commit string, path string"))
        got = V.timeline_of(intervals, samples)
        assert rows(got.select(*want.columns)) == rows(want)


def test_no_changes(spark):
    none = V.validity(spark.createDataFrame([], SCHEMA))
    got = V.timeline_of(none, spark.createDataFrame([("c1",)], "commit string")).first()
    assert got["files"] == 0 and got["langs"] == 0
