import random
from collections import Counter, defaultdict

import pytest
from test_bpe import PATH, theirs  # noqa: F401
from test_mixing import plan
from test_pii import slow_base
from test_simhash import slow_groups, slow_print

import corpus_pipeline as pipeline
from lithic.llm import pii, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(240):
        junk = i % 5 == 0
        words = [word().upper() + "!!" if junk else word() for _ in range(rng.randint(20, 120))]
        if i % 7 == 1:
            words.insert(3, rng.choice(["+1 (743) 555-3824", "a.b@c.example.com", "4785380592391139", "10.2.3.4"]))
        rows.append((i, " ".join(words), "en", rng.choice(["a", "a", "b", "c", None]), 0))
        labels.append((i, int(not junk), 0))
    rows += [(300 + k, rows[1 + k % 3][1], "en", "a", 0) for k in range(30)] + [(400, None, None, None, None), (401, "", "en", "b", 0), (2, rows[2][1], "en", rows[2][3], 0), (None, rows[3][1], "en", "a", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, folder, theirs):  # noqa: F811
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = pipeline.good_texts(spark, docs, path)
    score = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    good = [r for r in rows if score[r[0]] >= quality.GOOD]
    assert Counter(map(tuple, kept.collect())) == Counter(good) and kept.columns == columns
    assert len({r[0] for r in good} & {i for i in range(240) if i % 5}) > 185 and not {r[0] for r in good} & {i for i in range(240) if i % 5 == 0}

    once = pipeline.one_of_each_group(spark, kept, path)
    group = slow_groups({k: slow_print(r[1] or "") for k, r in enumerate(good)})
    best = {}
    for k, r in enumerate(good):
        best[group[k]] = min(best.get(group[k], r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert Counter(map(tuple, once.collect())) == Counter(best.values()) and once.columns == columns

    clean = pipeline.without_personal_data(spark, once, path)
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in best.values():
        text = r[1]
        for start, kind, end in reversed(slow_base(text or "")):
            text = f"{text[:start]}<{pii.KINDS[kind].upper()}>{text[end:]}"
        assert texts[r[0]] == text
    assert clean.columns == columns and all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean.collect())

    mixed = pipeline.mixed_by_source(spark, clean, path).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in clean.collect():
        size[r.source] += len((r.text or "").split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text)
    want = plan(size)
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 192) for s in want)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2

    last = pipeline.run(spark, path).collect()
    ids = Counter((r.doc_id, tuple(theirs.encode_ordinary(r.text))) for r in mixed)
    assert Counter((r.doc_id, tuple(r.ids)) for r in last) == ids and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_empty(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
