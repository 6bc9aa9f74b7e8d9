import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from lithic.llm import language

SF = "/root/testdata/sf0.01"


def slow_bits(text, counts):
    """Code length of a text from nested counts {context: Counter of bytes}."""
    total = 0.0
    for word in text.lower().split():
        data = b" " + word.encode() + b" "
        for i in range(1, len(data)):
            for order in range(min(language.ORDER, i), -1, -1):
                seen = counts.get(data[i - order : i])
                if not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                if seen[data[i]]:
                    total += math.log2((n + q) / seen[data[i]])
                    break
                total += math.log2((n + q) / q)
            else:
                total += 8
    return total


def test_lengths_match_a_plain_tree():
    learnt = {"a": "the theme of then and there the the", "b": "der die das und éé den dem"}
    counts, keys, langs, ns = {}, [], [], []
    for j, (name, text) in enumerate(learnt.items()):
        tree = defaultdict(Counter)
        for word in text.split():
            data = b" " + word.encode() + b" "
            for i in range(1, len(data)):
                for order in range(min(language.ORDER, i) + 1):
                    tree[data[i - order : i]][data[i]] += 1
        counts[name] = tree
        for context, seen in tree.items():
            for byte, n in seen.items():
                keys.append(int.from_bytes(context + bytes([byte]), "big") | (len(context) + 1) << 56)
                langs.append(j)
                ns.append(n)
    trees = language.Trees(list(learnt), np.array(keys, np.uint64), np.array(langs), np.array(ns, float))
    texts = ["the them", "Das ééx zzz", "", "there  und\nq", "t" * 300]
    got = language.Scorer(trees).texts(language.pa.array(texts))
    want = [[slow_bits(t, counts[n]) for n in learnt] for t in texts]
    assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(true) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == true[i] for i in held]) > 0.97


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog", "en", 1) for i in range(20)] + [(i, "der hund und die katze", "de", 1) for i in range(20, 40)]
    rows += [(50, None, "en", 1), (51, "", "en", 1), (52, " 12 !! ", None, 1), (None, "the dog", None, 1), (53, "x" * 100_000, None, 1), (54, "the the", None, 1), (54, "the the", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = language.identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[50] == by[51] == by[52] == "und" and by[None] == "en" and by[25] == "de" and by[54] == "en"
    nothing = docs.withColumn("lang", language.F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify(nothing).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0
