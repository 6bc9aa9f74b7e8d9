import random

import numpy as np
import xxhash

from lithic.llm import simhash


def slow_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(prints):
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdEÉx") for _ in range(rng.randint(1, 6)))
    out = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    base = [word() for _ in range(400)]
    for _ in range(25):
        copy = list(base)
        copy[rng.randrange(400)] = word()
        out.append("\t ".join(copy))
    return [*out, out[5], out[5], None, "", " \n", "one", "one two", "A B c\x1cd", "Ümlaut ÄÖ ÜÜ É"]


def test_groups_match_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(5)
    for chunk in (2048, 4):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.groups(docs, bucket_rows=chunk).collect()}
        prints = {i: slow_print(t or "") for i, t, _ in rows}
        group = slow_groups(prints)
        assert got == {i: (f"{prints[i]:016x}", group[i]) for i in prints}


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(empty).count() == 0
    twice = spark.createDataFrame([(7, "a b c"), (7, "a b c"), (None, "a b c"), (9, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.groups(twice).collect()) == [("7", 7), ("7", 7), ("9", 9), ("None", 7)]


def test_index_finds_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.r_[base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]])
    buckets = (codes % np.uint64(3)).astype(np.int64)
    order = np.lexsort((simhash.gray_rank(codes), buckets))
    index, label = simhash.GrayIndex(buckets[order], codes[order]), np.arange(len(codes))
    for a, b in index.links(3):
        label = simhash.merge(label, a, b)
    want, c, k = np.arange(len(codes)), codes[order], buckets[order]
    near = np.argwhere((np.bitwise_count(c[:, None] ^ c[None, :]) <= 3) & (k[:, None] == k[None, :]))
    want = simhash.merge(want, near[:, 0], near[:, 1])
    assert (label == want).all()
    rank = simhash.gray_rank(np.array([0b000, 0b001, 0b011, 0b010, 0b110, 0b111, 0b101, 0b100], np.uint64))
    assert rank.tolist() == list(range(8))
