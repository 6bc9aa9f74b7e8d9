import hashlib
import random
from zlib import crc32

import numpy as np

from lithic.llm import periodic, queries


def slow_runs(w):
    """All runs by comparing every word with the one a period before, for every period."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, own = i - q, w[i - q : j]
            if len(own) >= max(6, 4 * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.add((s, len(own), q))
            i = max(j, i + 1)
    return sorted(out)


def planted(rng):
    n, kinds = rng.randint(0, 90), rng.choice((1, 2, 2, 3, 30))
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 4:
            i, p, m = rng.randrange(n), rng.randint(1, max(1, n // 5)), rng.randint(1, n)
            for t in range(i + p, min(n, i + m)):
                w[t] = w[t - p]
    return w


def test_runs_match_brute_force_for_any_pieces():
    rng = random.Random(7)
    for _ in range(400):
        w = planted(rng)
        for most in (1, 17, 1000):
            catchers, at = periodic.Catchers(), 0
            while at < len(w):
                step = rng.randint(1, most)
                catchers.append(np.array(w[at : at + step]))
                at += step
            assert catchers.runs() == slow_runs(w)


def test_long_repetition_is_one_run():
    assert periodic.runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs_of([b"x", *([b"a", b"b", b"c"] * 50_000), b"y"]) == [(1, 150_000, 3)]


def digest(doc_id, text):
    words = [x for x in (text or "").encode().split()]
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(map(str, planted(rng))), "x") for i in range(300)]
    rows += [(300, None, "x"), (301, "", "x"), (302, " \t\n", "x"), (None, "a " * 9, "x"), (5, rows[5][1], "y"), (303, "  \x1c a\x0bb " * 8, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_dyadic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = repr
    assert sorted(map(tuple, got.collect()), key=key) == sorted((digest(d, t) for d, t, _ in rows), key=key)
    assert sum(r.n_runs > 0 for r in got.collect()) > 60
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digest(periodic.detect(empty)).count() == 0
