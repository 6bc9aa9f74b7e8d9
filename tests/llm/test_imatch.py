import hashlib
import random

from lithic.llm import imatch


def corpus():
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(400)]
    return [(i * 3 % 97 + 1000 * (i // 97), " ".join(rng.choice(vocabulary) + rng.choice(["", "é😀"]) for _ in range(rng.randint(0, 80))), "x") for i in range(240)]


def slow(rows, words):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    printer, out = imatch.Printer(words), []
    for i, (doc_id, text, _) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        new = text[: n - n // 2] + following[: n // 2]
        a, b, c = printer(text), printer(new), printer(following)
        out.append((doc_id, n, hashlib.sha256(new.encode()).hexdigest(), a, b, imatch.likeness(a, b), imatch.likeness(a, c)))
    return sorted(out, key=str)


def test_rows_match_a_plain_walk(spark):
    for rows in (corpus(), [*corpus()[:30], (5, None, "x"), (5, None, "x"), (None, "lost one", "x"), (None, None, "x"), (7000, "z " * 90_000, "x"), (0, "same same", "x"), (0, "same same", "x")], [(4, "only one here", "x")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string").repartition(4)
        words = imatch.lexicon(docs, 1 / 50, 1 / 8)
        assert sorted(map(tuple, imatch.with_next(docs, words).collect()), key=str) == slow(rows, words)


def test_lexicon_is_the_band(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BLOCK_TERMS", 60)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string").repartition(5)
    share = {w: sum(w in imatch.terms(t) for _, t, _ in rows) / len(rows) for _, t, _ in rows for w in imatch.terms(t)}
    assert imatch.lexicon(docs, 1 / 20, 1 / 12) == {w for w, s in share.items() if 1 / 20 <= s <= 1 / 12}
    assert imatch.lexicon(docs.limit(0)) == frozenset() and imatch.with_next(docs.limit(0)).count() == 0


def test_likeness_follows_shared_terms():
    printer, rng = imatch.Printer(frozenset()), random.Random(9)
    base = ["t%d" % i for i in range(200)]
    seen = []
    for changed in (0, 2, 20, 100, 200):
        near = [imatch.likeness(printer(" ".join(base)), printer(" ".join([*base[changed:], *("n%d" % rng.random() if 0 else "n%d" % rng.randrange(10**9) for _ in range(changed))]))) for _ in range(20)]
        seen.append(sum(near) / 20)
    assert seen[0] == 1 and sorted(seen, reverse=True) == seen and seen[-1] < 0.1 < seen[2]
