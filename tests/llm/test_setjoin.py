import random

import numpy as np

from lithic.llm import setjoin


def families(rng):
    """Sets of members, near copies among them."""
    out = []
    for _ in range(rng.randint(1, 4)):
        base = [rng.getrandbits(64) for _ in range(rng.choice([1, 2, 5, 9, 12, 19, 30, 60, 150, 400]))]
        for _ in range(rng.randint(1, 12)):
            x = set(base)
            for _ in range(rng.randint(0, max(1, len(base) // 8))):
                if x and rng.random() < 0.6:
                    x.discard(rng.choice(sorted(x)))
                if rng.random() < 0.6:
                    x.add(rng.getrandbits(64))
            if x:
                out.append(tuple(sorted(x)))
    return [np.array(x, np.uint64) for x in sorted(set(out))]


def test_cells_lose_no_link_and_search_finds_them():
    rng, links = random.Random(4), 0
    for _ in range(150):
        p, sets = rng.choice([80, 90, 95]), families(rng)
        plain, keys = [set(x.tolist()) for x in sets], [set(setjoin.cells(x, p).tolist()) for x in sets]
        linked = lambda a, b, p=p: 100 * len(a & b) >= p * len(a | b)
        want, got = setjoin.Groups(len(sets)), setjoin.Groups(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if linked(plain[i], plain[j]):
                    links += 1
                    want.join(i, j)
                    assert keys[i] & keys[j]
        for i, j in setjoin.within(sets, p)[0]:
            assert linked(plain[i], plain[j])
            got.join(i, j)
        n = len(sets)
        assert len({(want.root(i), got.root(i)) for i in range(n)}) == len({want.root(i) for i in range(n)}) == len({got.root(i) for i in range(n)})
    assert links > 1000


def test_sets_with_empty_parts_meet():
    # all members in a few ranges of hashes: most parts are empty under the first seed
    low = np.arange(1, 41, dtype=np.uint64)
    a, b = low, np.r_[low[:-1], np.uint64(99)]
    assert set(setjoin.cells(a).tolist()) & set(setjoin.cells(b).tolist())


def slow(rows):
    sets = []
    for _, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x.decode() for x in lower.encode().split()]
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for g, (d, _) in zip(group, rows, strict=True):
        if d is not None:
            low[g] = min(low.get(g, d), d)
    return sorted(((d, len(s), low.get(g) if s else d) for g, s, (d, _) in zip(group, sets, rows, strict=True)), key=repr)


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgÄB") for _ in range(rng.randint(2, 7)))
    rows = []
    for family in range(8):
        text = [word() for _ in range((12, 21, 25, 60, 120, 200, 200, 400)[family])]
        for k in range(14):
            own = list(text)
            for at in rng.sample(range(len(text)), min(len(text), (0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 12, 20, 30)[k] * len(text) // 150)):
                own[at] = word()
            rows.append((family * 20 + k, " ".join(own[: len(own) - k % 3])))
    rows += [(500, None), (501, ""), (502, "two words"), (503, "Two\t words"), (504, " \n"), (505, "one"), (None, rows[20][1]), (None, "alone here now"), (7, rows[7][1]), (-3, rows[3][1].upper())]
    rng.shuffle(rows)
    return rows


def test_groups_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").repartition(4)
    want = slow(rows)
    for slice_sets in (1024, 3):
        got = setjoin.groups(docs, slice_sets=slice_sets)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert setjoin.groups(docs.limit(0)).count() == 0
