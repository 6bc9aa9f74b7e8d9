"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

`statistics` reduces every whole text to a short row of numbers. `fit` standardises them over the labelled rows, maps
them through `FEATURES` random cosines (which approximate a Gaussian kernel), adds up the normal equations inside each
task, sums those parts by matrix cell in Spark and solves the small system on the driver. The raw scores of the
labelled rows are then counted in `BINS` cells and pooled into a rising curve, which turns a raw score into the
share of good documents. Every labelled row takes part; what reaches the driver has a fixed size.

Defined results: null and empty texts have all statistics zero and get a score as any other text; rows without a label
teach nothing; with no labelled row every score is 0.5; with one class only, that class's share; repeated rows count
as often as they occur; extra columns are passed on by `keep_good` and ignored elsewhere; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import blobs, bounded_batches, held_out, text_slices
from lithic.session import cut

FEATURES, RIDGE, BINS, SEED = 128, 1.0, 1000, 11
#: A document is good from this score on.
GOOD = 0.7

STATS = """log_bytes log_words word_bytes long_words upper digit comma stop mark symbol other_bytes line_breaks
marked_words upper_words plain_words distinct_words top_word repeated_lines line_words""".split()
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "comma": b",;:", "stop": b".", "mark": b"!?\"'()-", "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "line_breaks": b"\n"}
_CLASS_OF = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES.values(), 1):
    _CLASS_OF[list(_chars)] = _k
_CLASS_OF[128:] = len(_CLASSES) + 1


def statistics_of(text: bytes) -> list[float]:
    """The numbers named in STATS; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    n, seen = len(words), Counter(words)
    share = dict(zip(("none", *_CLASSES, "other_bytes"), np.bincount(_CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 2) / len(text), strict=True))
    plain = marked = upper = lengths = long = 0
    for w, c in seen.items():
        body = w.rstrip(b".,;:")
        marked += c * (not body.replace(b"'", b"").replace(b"-", b"").isalnum() and body.isascii())
        plain += c * body.isalpha()
        upper += c * (len(body) > 1 and body.isupper())
        lengths += c * len(w)
        long += c * (len(w) > 14)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(len(text)), np.log1p(n), lengths / n, long / n, *(float(share[k]) for k in ("upper", "digit", "comma", "stop", "mark", "symbol", "other_bytes", "line_breaks")),
        marked / n, upper / n, plain / n, len(seen) / n, max(seen.values()) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, one double column per entry of STATS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = np.array([statistics_of(t) for t in blobs(batch.column("text"))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(rows[:, k].copy()) for k in range(len(STATS)))], ["doc_id", "held_out", *STATS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = bounded_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, " + ", ".join(f"{s} double" for s in STATS))


@dataclass
class Model:
    """Everything needed to score; a few kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.c_[np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(z))]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def pooled(at: np.ndarray, good: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising curve through shares good/seen at ascending points (pool adjacent violators), as knots and levels."""
    blocks: list[list[float]] = []
    for x, g, n in zip(at, good, seen, strict=True):
        blocks.append([x * n, g, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in (*STATS, *(["y"] if "y" in batch.schema.names else []))])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from the rows of `statistics` that are not held out and whose `label` is 0 or 1."""
    marks = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter("y in (0, 1)")
    train = cut(stats.filter(~F.col("held_out")).join(marks, "doc_id").select(*STATS, "y"))
    sums = train.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *(F.avg(s).alias(f"m_{s}") for s in STATS), *(F.stddev_pop(s).alias(f"d_{s}") for s in STATS)).first()
    rng, width = np.random.default_rng(SEED), len(STATS)
    if not sums.n:
        return Model(np.zeros(width), np.ones(width), np.zeros((width, FEATURES)), np.zeros(FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    mean, scale = (np.array([sums[f"{k}_{s}"] for s in STATS]) for k in "md")
    model = Model(
        mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / np.sqrt(width), (width, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1),
    )
    row, col = np.triu_indices(FEATURES + 2)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 2, FEATURES + 2))
        for part in _matrix(batches):
            z = np.c_[model.features(part[:, :-1]), part[:, -1]]
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(total[row, col])], ["i", "j", "v"])

    cells = train.mapInArrow(normal, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    gram = np.zeros((FEATURES + 2, FEATURES + 2))
    gram[cells["i"], cells["j"]] = gram[cells["j"], cells["i"]] = cells["v"]
    ridge = RIDGE * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(gram[:-1, :-1] + ridge, gram[:-1, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _matrix(batches):
            cell = np.clip(np.rint(model.raw(part[:, :-1]) * BINS / 2), -BINS, BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[:, -1].copy())], ["cell", "y"])

    curve = train.mapInArrow(binned, "cell long, y double").groupBy("cell").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("cell").toArrow()
    model.knots, model.levels = pooled(*(np.asarray(c, np.float64) for c in (np.asarray(curve["cell"]) * 2 / BINS, curve["good"], curve["n"])))
    return model


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `statistics`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(next(_matrix(iter([batch]))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out, and score every document."""
    stats = cut(statistics(docs))
    return scores(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches GOOD."""
    model = fit(cut(statistics(docs)), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = np.array([statistics_of(t) for t in blobs(batch.column("text"))], np.float64)
            yield batch.filter(pa.array(model.score(rows) >= GOOD))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
