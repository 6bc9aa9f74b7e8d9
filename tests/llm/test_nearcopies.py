import random

from lithic.llm import nearcopies


def slow(rows):
    """Ids that are kept: all pairs compared, groups closed over links."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, (d, _) in zip(group, rows, strict=True):
        best[g] = min(best.get(g, d), d, key=lambda x: (x is None, x or 0))
    return sorted(best.values(), key=str)


def test_near_copies_by_similarity(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = []
    for base in range(12):
        text = [word() for _ in range(200)]
        for k in range(8):
            own = list(text)
            for at in rng.sample(range(200), (0, 1, 2, 2, 3, 6, 12, 30)[k]):
                own[at] = word()
            rows.append((base * 10 + k, " ".join(own)))
    rows += [(500, None), (501, ""), (502, "two words"), (503, "Two  words"), (None, rows[0][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = nearcopies.representatives(docs)
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert got == slow(rows) and kept.columns == docs.columns
    # two words of 200 replaced: the similarity is about 0.9
    assert not {base * 10 + k for base in range(12) for k in (1, 2, 3)} & set(got)
    assert nearcopies.representatives(docs.limit(0)).count() == 0


def test_links_between_nodes_that_are_not_the_smallest_of_a_cluster(spark):
    own = {n: nearcopies.np.arange(n, n + 100, dtype=nearcopies.np.uint64) for n in (1, 9, 17, 60, 68, 400)}
    members = spark.createDataFrame([(n, 7, bytearray(s.tobytes())) for n, s in own.items()], "node long, cluster long, own binary")
    for slice_sets in (1024, 2):
        got = {r.id: r.component for r in nearcopies.components(members, slice_sets).collect()}
        assert {n: got.get(n, n) for n in own} == {1: 1, 9: 1, 17: 1, 60: 60, 68: 60, 400: 400}


def test_cells_are_shared_above_the_similarity_and_hardly_far_below():
    rng = nearcopies.np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**63, n).astype(nearcopies.np.uint64)

    def share(like, trials=300, n=200):
        both, hit = round(2 * n * like / (1 + like)), 0
        for _ in range(trials):
            x = draw(2 * n)
            a, b = nearcopies.np.unique(x[:n]), nearcopies.np.unique(nearcopies.np.r_[x[:both], x[n : 2 * n - both]])
            hit += bool(set(nearcopies.cells(a).tolist()) & set(nearcopies.cells(b).tolist()))
        return hit / trials

    assert share(0.8) > 0.98 and share(0.9) == 1 and share(0.3) < 0.03
    assert len(nearcopies.cells(draw(0))) == 0 and len(nearcopies.cells(draw(5000))) == nearcopies.KEYS


def test_clashing_columns_are_kept(spark):
    rows = [(1, "one two three four five six", 5, {"a": 1}), (2, "one two three four five six", 6, {"b": 2}), (3, None, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, first map<string, int>")
    got = nearcopies.representatives(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.node, r.first) for r in got.collect()) == [(1, 5, {"a": 1}), (3, 7, None)]
