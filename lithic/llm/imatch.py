"""I-Match document fingerprints.

* Lexicon: terms (lower-case words) that occur in a share of all documents between LOW and HIGH. A block of documents can
  only hold such a term below the share LOW if another block holds it above, so a first pass names the terms that
  are frequent in some block, and a second one counts just these in all documents. At most (mean terms of a document) /
  LOW terms can pass, whatever the size of the corpus; that is what is shared with the tasks.
* Fingerprint: the distinct lexicon terms of a text are sorted. A hash of all of them comes first; then follows one hash for
  each of SUBSETS lexicon subsets, to which a term belongs by its own hash, at rates from 1/2048 up to 1/4.
* Likeness: the share of subsets with equal hashes among the first ENOUGH (in order of rising rate) that hold a term of
  either text. So the sparse subsets decide where they hold enough, and the dense ones help out for short texts.

Texts with fewer than FEW lexicon terms use all their terms. Defined results: null is the empty text; texts without terms
share one fingerprint and are alike (1.0) to each other only; equal texts have equal fingerprints; documents with equal
ids follow each other in order of text, null ids come first; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import strings, tasks_for, text_slices
from lithic.session import cut

LOW, HIGH, FEW = 1 / 2000, 1 / 8, 4
RATES = tuple(2.0**-k for k in range(11, 1, -1))
SUBSETS, ENOUGH = 8 * len(RATES), 16
#: Distinct terms a block of documents may hold before it is closed.
BLOCK_TERMS = 400_000


def terms(text: str) -> set[str]:
    return set(text.lower().split())


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> frozenset[str]:
    """The terms whose share of all documents lies within [low, high]."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t for t, c in seen.items() if c >= low * n], pa.string())], ["term"])

        for batch in text_slices(batches):
            for text in strings(batch.column("text")):
                seen.update(terms(text))
                n += 1
                if len(seen) > BLOCK_TERMS:
                    yield close()
                    seen, n = Counter(), 0
        yield close()

    named = texts.mapInArrow(frequent, "term string").groupBy("term").count()
    candidates = spark.sparkContext.broadcast(frozenset(named.select("term").toArrow()["term"].to_pylist()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen, n = candidates.value, Counter(), 0
        for batch in text_slices(batches):
            for text in strings(batch.column("text")):
                seen.update(terms(text) & wanted)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.string()), pa.array([n, *seen.values()], pa.int64())], ["term", "n"])

    sums = cut(texts.mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
    total = sums.filter("term is null").first()
    n = total.n if total else 0
    band = sums.filter(F.col("term").isNotNull() & F.col("n").between(low * n, high * n))
    return frozenset(band.select("term").toArrow()["term"].to_pylist())


class Printer:
    """Fingerprints over one lexicon."""

    def __init__(self, words: frozenset[str]):
        self.words, self.member = words, {}

    def subsets(self, term: str) -> tuple[int, ...]:
        """The lexicon subsets that hold a term."""
        known = self.member.get(term)
        if known is None:
            data = term.encode("utf-8", "surrogatepass")
            known = tuple(j for j in range(SUBSETS) if xxhash.xxh64_intdigest(data, j) < RATES[j // 8] * 2.0**64)
            if term in self.words:
                self.member[term] = known
        return known

    def __call__(self, text: str) -> str:
        own = terms(text)
        kept = sorted(k) if len(k := own & self.words) >= FEW else sorted(own)
        parts: list[list[str]] = [[] for _ in range(SUBSETS)]
        for term in kept:
            for j in self.subsets(term):
                parts[j].append(term)
        code = lambda p: f"{xxhash.xxh64_intdigest(' '.join(p).encode('utf-8', 'surrogatepass')) % 0xFF + 1:02x}" if p else "00"
        return f"{xxhash.xxh64_intdigest(' '.join(kept).encode('utf-8', 'surrogatepass')):016x}" + "".join(map(code, parts))


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    pairs = ((a[i : i + 2], b[i : i + 2]) for i in range(16, len(a), 2))
    some = [x == y for x, y in pairs if x != "00" or y != "00"][:ENOUGH]
    return sum(some) / len(some) if some else 0.0


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, last, doc_id, text): rows dealt out by ranges of doc_id; each range ends with a copy (last = 1) of the next range's first row.

    The ranges come from approximate quantiles; the list of their first ids has an entry per range.
    """
    n = tasks_for(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    splits = sorted(set(rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    passed = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= F.col("doc_id"))) if splits else F.lit(0)
    placed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(passed + 1).cast("int"))
    heads = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("low")).collect())
    if not heads:
        return placed.select("bucket", F.lit(0).alias("last"), "doc_id", "text")
    first = placed.filter(F.col("doc_id").isin([low for _, low in heads if low is not None]) | (F.col("doc_id").isNull() if heads[0][0] == 0 else F.lit(False)))
    ends = first.groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    back = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("bucket"))
    ends = ends.select(back.alias("bucket"), F.lit(1).alias("last"), "doc_id", "text")
    both = placed.select("bucket", F.lit(0).alias("last"), "doc_id", "text").unionByName(ends)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "last", F.asc_nulls_first("doc_id"), "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the start of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, words: frozenset[str] | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it is to this and to the next document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs) if words is None else words)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        print_of, prev = Printer(shared.value), None
        for batch in text_slices(batches):
            out = []
            for bucket, last, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "last", "doc_id", "text")), strict=True):
                mark = print_of(text)
                if prev and prev[0] == bucket:
                    _, own_id, own, own_mark = prev
                    new = edited(own, text)
                    new_mark = own_mark if new == own else print_of(new)
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, len(own), digest, own_mark, new_mark, likeness(own_mark, new_mark), likeness(own_mark, mark)))
                prev = None if last else (bucket, doc_id, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kind = docs.schema["doc_id"].dataType
    kinds = [pa.int64() if kind.simpleString() == "bigint" else None, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return in_order(docs).mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
