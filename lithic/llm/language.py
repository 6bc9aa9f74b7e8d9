"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes. A byte costs log2((n + q) / c) bits in a context that was
seen n times before q different bytes, c times before this one; a context that never saw the byte costs an escape of
log2((n + q) / q) bits and the next shorter context is asked, down to 8 bits for a byte no context knows (method C,
without exclusions). Counts are frozen, so a code length depends on the text alone. A context never reaches back beyond the
white space before a word; the length of a text is then the sum over its words, and a word is coded once and looked up
again. Letters are compared in lower case.

The trees are learnt from about TRAIN_DOCS documents of each language, chosen by a hash of doc_id among those that are not
held out; contexts of three bytes and more need a second sighting to be kept.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything if nothing could be
learnt; ties go to the first language in code point order; rows without a language teach nothing; repeated rows are
predicted one by one; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import held_out, text_slices

ORDER, TRAIN_DOCS, WORDS, SLICE = 5, 1500, 300_000, 4 << 20
UNKNOWN = "und"


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words, the place of each word among them, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))))
    coded = lists.flatten().dictionary_encode()
    starts = lists.offsets.to_numpy()
    return coded.dictionary, coded.indices.to_numpy(), (starts - starts[0]).astype(np.int64)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of each word (and the space after it): contexts and context + byte by order, and its word.

    A key holds its length and up to seven bytes; 0 means that the context would reach beyond the word.
    """
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(1, len(word) + 1)
    context, contexts, full = np.zeros(len(word), np.uint64), [], []
    for order in range(ORDER + 1):
        if order:
            back = np.maximum(at - order, 0)
            context = context | joined[back] << np.uint64(8 * (order - 1))
        fits = within + 1 >= order
        mark = np.uint64((order + 1) << 56)
        contexts.append(np.where(fits, context | mark, 0))
        full.append(np.where(fits, (context << np.uint64(8)) | joined[at] | mark, 0))
    return np.array(contexts), np.array(full), word


class Trees:
    """Code lengths of all languages: one row per context and per context + byte, one column per language."""

    def __init__(self, languages: list[str], key: np.ndarray, language: np.ndarray, count: np.ndarray):
        self.languages = languages
        self.keys, row = np.unique(key.astype(np.uint64), return_inverse=True)
        seen = np.zeros((len(self.keys), len(languages)))
        np.add.at(seen, (row, language), count)
        mark = self.keys >> np.uint64(56) << np.uint64(56)
        above, place = np.unique((self.keys ^ mark) >> np.uint64(8) | mark, return_inverse=True)
        n, q = np.zeros((len(above), len(languages))), np.zeros((len(above), len(languages)))
        np.add.at(n, place, seen)
        np.add.at(q, place, seen > 0)
        self.contexts = above
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.where(n > 0, np.log2((n + q) / q), 0.0)
            self.cost = np.where(seen > 0, np.log2((n + q)[place] / seen), np.inf)

    @staticmethod
    def _rows(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Code length in bits of each word (with the space after it) in each language."""
        contexts, full, word = grams(words)
        bits = np.zeros((len(word), len(self.languages)))
        left = np.ones_like(bits, bool)
        for order in range(ORDER, -1, -1):
            use = np.flatnonzero(left.any(1) & (contexts[order] > 0))
            at, known = self._rows(self.contexts, contexts[order][use])
            use, at = use[known], at[known]
            row, there = self._rows(self.keys, full[order][use])
            cost = np.where(there[:, None], self.cost[row], np.inf)
            open_ = left[use]
            hit = open_ & np.isfinite(cost)
            bits[use] += np.where(hit, cost, np.where(open_, self.escape[at], 0))
            left[use] = open_ & ~hit
        bits += 8.0 * left
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        return np.add.reduceat(bits, starts, axis=0) * (np.fromiter(map(len, words), np.int64, len(words)) > 0)[:, None]


class Scorer:
    """Code lengths of words, remembered."""

    def __init__(self, trees: Trees):
        self.trees, self.place, self.rows = trees, {}, np.zeros((0, len(trees.languages)))

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > WORDS:
            self.place, self.rows = {}, self.rows[:0]
        fresh = [w for w in words if w not in self.place]
        if fresh:
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.rows = np.r_[self.rows, *(self.trees.lengths(fresh[at : at + 65536]) for at in range(0, len(fresh), 65536))]
        return self.rows[[self.place[w] for w in words]]

    def texts(self, column: pa.Array) -> np.ndarray:
        """Code length of each text in each language."""
        distinct, place, starts = words_of(column)
        total = np.zeros((len(column), len(self.trees.languages)))
        if len(distinct):
            cost = self.words(distinct.cast(pa.large_binary()).to_pylist())
            some = starts[1:] > starts[:-1]
            total[some] = np.add.reduceat(cost[place], starts[:-1][some], axis=0)
        return total


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Trees | None:
    """Context trees of all languages found in `lang`; None if there is none."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.groupBy("lang").count().collect()  # one row per language, as in the model itself
    if not counts:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, train_docs / r["count"])))), F.col("lang"))
    lot = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1e6
    sample = rows.filter(lot < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                distinct, place, _ = words_of(own.column("text"))
                if not len(distinct):
                    continue
                _, full, word = grams(distinct.cast(pa.large_binary()).to_pylist())
                weight = np.bincount(place, minlength=len(distinct))[word]
                key, back = np.unique(full, return_inverse=True)
                n = np.bincount(back.ravel(), np.tile(weight, len(full)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int((key > 0).sum())), pa.array(key[key > 0].view(np.int64)), pa.array(n[key > 0].astype(np.int64))], ["lang", "key", "n"])

    counted = sample.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    kept = counted.filter((F.col("n") > 1) | (F.col("key") < F.lit(4 << 56))).toArrow()
    if not kept.num_rows:
        return None
    lang = kept["lang"].combine_chunks()
    languages = sorted(pc.unique(lang).to_pylist())
    return Trees(languages, np.asarray(kept["key"], np.int64).view(np.uint64), pc.index_in(lang, pa.array(languages)).to_numpy(), np.asarray(kept["n"], np.float64))


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language with the shortest code, and its share of probability."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample it was learnt from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in text_slices(batches, limit=SLICE):
            lettered = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False)
            names, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            use = lettered.to_numpy(zero_copy_only=False)
            if scorer and use.any():
                bits = scorer.texts(batch.column("text").filter(lettered))
                best = bits.argmin(1)
                names[use] = np.array(scorer.trees.languages, object)[best]
                score[use] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, and predict every document."""
    return predict(docs, learn(docs))
