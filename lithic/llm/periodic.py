"""Periodic runs of words, caught online over dyadic blocks.

A run is a stretch of words with smallest period q, of at least max(SHORTEST, FOLDS * q) words, that no neighbouring word extends.

1. Words arrive in pieces of any length, down to one. For each k the words are cut into blocks of 2^k, and each completed block is
   looked up among the windows that lie 2^k to 2^(k+1) - 1 words before it, by their hashes. A run of four periods q with
   2^k <= q < 2^(k+1) holds two such blocks in a row, each equal to the words q before it.
2. Such a pair is a catcher: a suffix comparison backwards finds where the repetition starts, and one forwards goes on with
   each appended word. A square is complete once q words in a row equal those q before them; squares of one period that follow each
   other are one run, which ends at the first word that differs.
3. A block inside a known run of period r is not caught again at multiples of r, so one word repeated a million times is one run.

Words are compared themselves; hashes only find where to look. Each level costs one comparison a word, so a text of n words costs
n log n. A text is handled in one task, in memory of a few numbers a word.

Defined results: null, empty and blank texts have no words and no runs; repeated rows are kept, each with its own result; a null
doc_id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import blobs, text_slices

#: A run has at least SHORTEST words and FOLDS periods; FOLDS is 4 at least, so that every run holds a pair of blocks.
SHORTEST, FOLDS = 6, 4
#: Words appended at once when whole texts are read.
PIECE = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

Run = tuple[int, int, int]


class Catchers:
    """Runs of a growing sequence of word numbers."""

    def __init__(self) -> None:
        self.size = 0
        self.words, self.sums = np.zeros(0, np.int64), np.zeros(1, np.uint64)
        self.open: dict[int, int] = {}  # period: start of the repetition that reaches the last word
        self.closed: list[Run] = []
        self.upto: dict[int, int] = {}  # period: end of the repetition caught last
        self.blocks: list[int] = []  # blocks of each level that have been looked up

    def _grow(self, codes: np.ndarray) -> None:
        start, end = self.size, self.size + len(codes)
        if end > len(self.words):
            more = max(64, end, 2 * len(self.words))
            self.words = np.r_[self.words[:start], np.zeros(more - start, np.int64)]
            self.sums = np.r_[self.sums[: start + 1], np.zeros(more - start, np.uint64)]
            self.power, self.back = (np.r_[np.uint64(1), np.multiply.accumulate(np.full(more, b))] for b in (_BASE, _INVERSE))
        self.words[start:end] = codes
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * _BASE
        mixed ^= mixed >> np.uint64(31)
        self.sums[start + 1 : end + 1] = self.sums[start] + np.cumsum(mixed * self.power[start:end], dtype=np.uint64)
        self.size = end

    def _forward(self, at: int, period: int) -> int:
        """The first place from `at` on whose word differs from the one a period before, or the end."""
        step = 64
        while at < self.size:
            n = min(step, self.size - at)
            differ = self.words[at : at + n] != self.words[at - period : at - period + n]
            if differ.any():
                return at + int(differ.argmax())
            at, step = at + n, 4 * step
        return at

    def _backward(self, at: int, period: int) -> int:
        """The smallest start such that all words from start + period up to `at` equal those a period before."""
        step = 64
        while at > period:
            n = min(step, at - period)
            differ = (self.words[at - n : at] != self.words[at - period - n : at - period])[::-1]
            if differ.any():
                return at - int(differ.argmax()) - period
            at, step = at - n, 4 * step
        return at - period

    def _close(self, start: int, end: int, period: int) -> None:
        if end - start >= max(SHORTEST, FOLDS * period):
            self.closed.append((start, end, period))

    def _known(self, span: int, after: int) -> list[Run]:
        """Runs of at least `span` words that reach beyond `after`."""
        return [r for r in [*self.closed, *((s, self.size, q) for q, s in self.open.items())] if r[1] - r[0] >= span and r[1] > after]

    def append(self, codes: np.ndarray) -> None:
        seen = self.size
        self._grow(np.asarray(codes, np.int64))
        for period, start in list(self.open.items()):
            end = self.upto[period] = self._forward(seen, period)
            if end < self.size:
                self._close(start, end, period)
                del self.open[period]
        k = 0
        while 4 << k <= self.size:
            if k == len(self.blocks):
                self.blocks.append(2)
            self._look_up(k, self.size >> k)
            k += 1

    def _look_up(self, k: int, completed: int) -> None:
        """Catch pairs of blocks (b, b + 1) of level k, both completed, that equal the words one period before."""
        span, low = 1 << k, self.blocks[k]
        if completed - low < 2:
            return
        self.blocks[k] = completed - 1
        first, last = (low - 2) * span, completed * span  # words at hand
        hashes = (self.sums[first + span : last + 1] - self.sums[first : last + 1 - span]) * self.back[first : last + 1 - span]
        equal = hashes[2 * span :: span, None] == hashes[1 : 1 + (completed - low) * span].reshape(-1, span)
        row, column = np.nonzero(equal[:-1] & equal[1:])
        if not len(row):
            return
        place, period = (row + low) * span, 2 * span - 1 - column
        if k:
            cover = np.zeros((completed - low, 2), np.int64)  # start and period of the run around each block
            for s, e, q in self._known(2 * span, first):
                if q < span:
                    a, b = max(-(-s // span) + 1, low), min(e // span, completed)
                    cover[max(0, a - low) : max(0, b - low)] = s, q
            s, q = cover[row].T
            fresh = (q == 0) | (place - period < s) | (period % np.maximum(q, 1) != 0)
            place, period = place[fresh], period[fresh]
        order = np.lexsort((place, period))
        for i, q in zip(place[order].tolist(), period[order].tolist(), strict=True):
            if i < self.upto.get(q, 0):
                continue
            start, end = self._backward(i, q), self._forward(i, q)
            if end < i + span:
                continue  # equal hashes of unequal words
            self.upto[q] = end
            if end == self.size:
                self.open[q] = start
            else:
                self._close(start, end, q)

    def runs(self) -> list[Run]:
        """(start, length, period) of the runs of all words so far, by start and period."""
        least: dict[tuple[int, int], int] = {}
        for s, e, q in self._known(SHORTEST, -1):
            if e - s >= FOLDS * q:
                least[s, e] = min(q, least.get((s, e), q))
        return sorted((s, e - s, q) for (s, e), q in least.items())


def runs_of(words: list[bytes]) -> list[Run]:
    """(start, length, period) of the runs of a text, by start and period."""
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    catchers = Catchers()
    for at in range(0, len(codes), PIECE):
        catchers.append(codes[at : at + PIECE])
    return catchers.runs()


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run repeats: of each run the first period stays, unless another run drops it."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return words if keep.all() else [words[i] for i in np.flatnonzero(keep)]


def detect(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of each whole text as structs of start, length and period, and the words that are left, joined by spaces.

    `edit` may change the words of a document first.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows, left = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), blobs(batch.column("text")), strict=True):
                words = text.split()
                if edit:
                    words = edit(doc_id, words)
                own = runs_of(words)
                rows.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                left.append(b" ".join(collapsed(words, own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(run)), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(found, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest one, and hashes of all runs and of the words that are left."""
    text = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    length = -F.col("top.n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), hashed(F.array_join(text, "")).alias("runs_sha256"), hashed(F.col("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.expr("-1000 * top.n div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
