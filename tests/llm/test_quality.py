import random
import zlib

import numpy as np

from lithic.llm import quality

SF = "/root/testdata/sf0.01"


def test_pooled_is_rising_and_keeps_the_mean():
    knots, levels = quality.pooled(np.arange(6.0), np.array([0, 2, 1, 0, 3, 4.0]), np.full(6, 4.0))
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    assert levels[0] == 0 and levels[-1] == 1


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9, auc
    assert np.mean([s >= 0.7 for s in good]) > 0.95


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "###"]) for _ in range(30)), 1) for i in range(60)] + [(None, None, 1), (70, "", 2), (70, "", 2), (71, "x" * 300_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(60)] + [(70, None), (None, 0)], "doc_id long, quality int")
    assert all(r.score == 1 for r in quality.classify(docs, one).collect())
    assert quality.keep_good(docs, one).columns == docs.columns and quality.keep_good(docs, one).count() == len(rows)
    assert quality.classify(docs.limit(0), one).count() == 0
