import hashlib
import math
import random

import numpy as np
import pytest

from lithic.llm import ballkmeans


def slow(rows, parts=8, entries=16, rounds=6):
    """Plain k-means, everything compared with everything in unbounded integers."""
    kept = [(v, x, lab) for v, x, lab in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = max(1, -(-max(len(x) for _, x, _ in kept) // parts))
    points = [[int(c) * 4096 if abs(c) >= 2.0**52 else math.floor(4096 * c) for c in [*x, *[0.0] * (parts * width - len(x))]] for _, x, _ in kept]
    cut = [[p[i * width : (i + 1) * width] for i in range(parts)] for p in points]
    books = [[c[i] for c in cut[:entries]] for i in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        codes = [[min(range(len(books[i])), key=lambda k: (far(c[i], books[i][k]), k)) for i in range(parts)] for c in cut]
        if step < rounds:
            for i in range(parts):
                for k in range(len(books[i])):
                    own = [c[i] for c, code in zip(cut, codes, strict=True) if code[i] == k]
                    if own:
                        books[i][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(far(c[i], books[i][code[i]]) for i in range(parts)) for c, code in zip(cut, codes, strict=True)]
    total = {}
    for (_, _, lab), e in zip(kept, error, strict=True):
        total[lab] = total.get(lab, 0) + e
    top = 2**63 - 1
    return [(v, "".join("%02x" % k for k in code), min(e, top), min(sum(min(x, top) for (_, _, m), x in zip(kept, error, strict=True) if m == lab), top), sha) for (v, _, lab), code, e in zip(kept, codes, error, strict=True)]


def test_assignment_equals_all_comparisons():
    rng = np.random.default_rng(2)
    for t in range(600):
        n, w, e = rng.integers(1, 60), rng.integers(1, 5), rng.integers(1, 17)
        high, kind = rng.choice([2, 5, 50, 10**6]), object if t % 10 == 0 else np.int64
        points, books = rng.integers(-high, high + 1, (n, 1, w)).astype(kind), [[rng.integers(-high, high + 1, (e, w)).astype(kind)]]
        for _ in range(4):
            book = books[-1][0].copy()
            moved = rng.random(e) < rng.choice([0.1, 0.5, 1])
            book[moved] += rng.integers(-2, 3, (moved.sum(), w)).astype(kind)
            books.append([book])
            state = ballkmeans.replay(points, books)[0]
            far = np.stack([ballkmeans.squares(points[:, 0], c) for c in book], 1)
            assert (state.entry == far.argmin(1)).all() and (state.far == far.min(1)).all()


@pytest.mark.parametrize("case", ["plain", "few", "odd", "huge"])
def test_codes_match_plain_k_means(spark, case):
    rng = random.Random(case)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(150)]
    if case == "few":
        rows = rows[:5] + [(5, [], 1), (6, None, 1)]
    if case == "odd":
        rows = [(v, x[: rng.choice([16, 13, 11])], lab) for v, x, lab in rows] + [(3, rows[3][1], 1), (None, rows[4][1], 2), (500, [float("nan")] * 16, 1), (501, [None, 1.0], 1), (502, [float("inf")], 1)]
    if case == "huge":
        rows += [(151, [1e30] * 16, 2), (152, [-3e9] * 16, 1), (153, [1e300] + [0.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("label", "label").repartition(4)
    df = df.selectExpr("*", "'c' as code")
    got = sorted((tuple(r) for r in ballkmeans.compress(df).collect()), key=repr)
    assert got == sorted(slow(rows), key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    got = ballkmeans.compress(empty)
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
