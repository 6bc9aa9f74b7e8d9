import random
from collections import defaultdict

from lithic.llm import mixing


def plan(sizes):
    """Targets by plain resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, fixed, pot = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = pot - sum(2 * sizes[s] for s in fixed)
        target = {s: 2 * sizes[s] if s in fixed else rest * w[s] / sum(w[f] for f in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        fixed |= over


def documents(spark, n=300):
    rng = random.Random(4)
    rows = [(i, " \n".join("w%d" % k for k in range(rng.randint(0, 90))), rng.choice(["a", "a", "a", "b", "c", "d", None]), "extra") for i in range(n)]
    rows += [(500, None, "b", "x"), (501, "", "zero", "x"), (7, "dup dup dup", "a", "x"), (7, "dup dup dup", "a", "x"), (None, "no id here", "b", "x"), (502, "long " * 20000, "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string"), rows


def test_mix(spark):
    docs, rows = documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total = defaultdict(int)
    for _, t, s, _ in rows:
        total[s] += len((t or "").split())
    want, by_id = plan(total), {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = by_id[r.doc_id, r.size]
        assert abs(r.target - want[s]) < 1e-3 and r.source_size == total[s] and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 3 * mixing.BLOCK) for s in want), (dict(taken), want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate([("big", 4000), ("a", 10), ("b", 20), ("c", 3), ("d", 30), ("d", 0), ("e", 1)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(docs).collect():
        if r.size:
            assert abs(r.taken - r.target) <= max(2, 0.02 * r.target), r


def test_mixed_rows(spark):
    docs, _ = documents(spark, 80)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = lambda t: len((t or "").split())
    assert sum(words(r.text) for r in out.collect()) == sum(r.taken for r in mixing.mix(docs).collect())
    whole = {r.text for r in docs.collect()}
    assert all(any(w and w.startswith(r.text) for w in whole) for r in out.collect())


def test_empty(spark):
    docs, _ = documents(spark, 1)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    blank = docs.withColumn("text", mixing.F.lit(None).cast("string"))
    assert {(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}
