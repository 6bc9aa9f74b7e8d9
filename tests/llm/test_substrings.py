import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from lithic.llm import substrings as sub


def slow(rows):
    first = {}
    for doc_id, text, _ in rows:
        data = (text or "").encode()
        if doc_id is not None:
            for i in range(len(data) - sub.LENGTH + 1):
                w = data[i : i + sub.LENGTH]
                first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text, _ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - sub.LENGTH + 1):
            if doc_id is not None and first[data[i : i + sub.LENGTH]] < doc_id:
                gone[i : i + sub.LENGTH] = b"\1" * sub.LENGTH
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)] + ["x" * 120, "ab" * 60, "\0\1" * 40]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 60)
            parts += [p[a : a + rng.randint(40, 130)], " ".join(word() for _ in range(rng.randint(0, 25)))]
        rows.append((i * 7 % 121, rng.choice(["", " "]).join(parts), "x"))
    return rows + [(200, rows[3][1], "x"), (201, rows[3][1], "x"), (201, rows[3][1], "x"), (202, None, "x"), (203, "", "x"), (None, rows[3][1], "x"), (204, passages[6] * 9, "x"), (5, passages[0], "x")]


def test_matches_brute_force(spark, monkeypatch):
    for seed, part_bytes, hot in ((1, 4 << 20, 50_000), (2, 2_000, 50_000), (3, 3_000, 3)):
        monkeypatch.setattr(sub, "HOT", hot)
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)
        got = sub.deduplicate(docs, part_bytes).drop("spans").collect()
        assert sorted(map(tuple, got), key=str) == slow(rows)
    assert sub.deduplicate(docs.limit(0)).count() == 0


def test_expansion_gives_the_classes_of_equal_prefixes():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, length = int(rng.integers(1, 80)), int(rng.integers(1, 12))
        text = rng.integers(0, 3, n)
        order, new = sub.expand(text, length)
        turns = [tuple(np.roll(text, -p)[np.arange(length) % n]) for p in order]
        assert turns == sorted(turns) and [bool(b) for b in new] == [i == 0 or turns[i] != turns[i - 1] for i in range(n)]


def test_long_texts_are_cut_into_overlapping_chunks(monkeypatch):
    monkeypatch.setattr(sub, "CHUNK_BYTES", 200)
    rows = [(0, bytes(np.random.default_rng(1).integers(0, 256, 1000, dtype=np.uint8))), (1, b""), (2, b"y" * 49), (3, b"z" * 50)]
    seen = [[] for _ in rows]
    for row, offset, runs in sub.chunks(rows):
        for s, c, t in zip(runs.start, runs.count, runs.text):
            seen[row[t]] += range(s - runs.begin[t] + offset[t], s - runs.begin[t] + offset[t] + c)
    assert [sorted(x) for x in seen] == [list(range(951)), [], [], [0]]


def grouped(tables, key):
    whole = pa.concat_tables(tables)
    return {k: whole.filter(pa.compute.equal(whole[key], k)) for k in whole[key].unique().to_pylist()}


def in_process(rows, parts):
    """The steps of deduplicate() in this process, where the sizes of chunks can be set."""
    docs = [(d, t or "", i % parts) for i, (d, t, _) in enumerate(rows) if d is not None]
    texts = grouped([pa.table(list(map(list, zip(*docs, strict=True))), names=["doc_id", "text", "part"])], "part")
    asked = grouped([sub._ask(t, parts) for t in texts.values()], "bucket")
    shared = grouped([sub._answer(t) for t in asked.values()], "part")
    sent = grouped([sub._send(t, shared.get(p, sub._table([], sub._SHARED)), 2 * parts) for p, t in texts.items()], "shard")
    found = grouped([sub._solve(t) for t in sent.values()], "part")
    done = pa.concat_tables([sub._remove(t, found.get(p, sub._table([], sub._FOUND))) for p, t in texts.items()])
    return sorted((tuple(r.values())[:5] for r in done.to_pylist()), key=str)


def test_a_run_in_several_chunks_of_a_part_is_answered_once(monkeypatch):
    for seed, parts, chunk, hot in ((5, 1, 300, 50_000), (6, 3, 500, 50_000), (7, 1, 400, 3), (8, 2, 1 << 20, 50_000)):
        monkeypatch.setattr(sub, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(sub, "HOT", hot)
        rows = [r for r in corpus(seed) if r[0] is not None]
        assert in_process(rows, parts) == slow(rows)
