"""SimHash near-duplicates through a hierarchical index over Gray order.

1. `fingerprints` turns every text into 64 majority bits over its hashed word shingles.
2. Equal fingerprints are one node from here on, so copies cost nothing.
3. With `radius` differing bits allowed, at least one of `radius + 1` bit blocks is equal in two linked
   fingerprints. Every fingerprint is dealt out once per block, keyed by the block's value. Keys that hold more than
   `BUCKET_ROWS` fingerprints are split into chunks, and each pair of chunks becomes one bucket, so no link is lost
   and no bucket exceeds two chunks.
4. Inside a bucket fingerprints are sorted by Gray rank. Runs of neighbours become nodes that store the bits all of
   them share; a child keeps only the bits its parent has not yet accounted for. A query walks down, adds up the
   differences in the shared bits, drops a node when they exceed the radius, and takes a whole node when even all
   of its open bits could not exceed it.
5. Each bucket sends on one edge per linked fingerprint (to the smallest of its local group), never all pairs;
   connected components close the groups.

Defined results: null and blank texts have fingerprint zero and are linked like any other; texts of fewer words than a
shingle are one shingle; repeated rows are kept; a null doc_id never names a component unless all its members are
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import blobs, bounded_batches, tasks_for, text_slices
from lithic.operators import traverse
from lithic.session import cut

WIDTH, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a bucket chunk; a bucket holds two chunks at most.
BUCKET_ROWS = 2048
#: Children of an index node, and query-node pairs looked at together.
FANOUT, PAIRS = 8, 2_000_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: bytes, width: int = WIDTH) -> int:
    """Majority bits over the hashes of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in map(b" ".join, grams)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and fp, the fingerprint of each row's `text` as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fps = np.array([simhash(t, width) for t in blobs(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))], [*keep, "fp"])

    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return bounded_batches(docs).select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kept}fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Shared-bit tree over codes that are sorted by bucket and, within a bucket, by Gray rank."""

    def __init__(self, buckets: np.ndarray, codes: np.ndarray):
        n = len(codes)
        self.codes = codes
        #: By level from the rows up: shared mask, pattern, first row, end row, first child, end child.
        self.levels = [(np.full(n, FULL), codes, np.arange(n), np.arange(1, n + 1), np.arange(n), np.arange(n))]
        owner = np.cumsum(np.r_[True, buckets[1:] != buckets[:-1]]) - 1 if n else np.zeros(0, np.int64)
        all_of, any_of, start, end = codes, codes, np.arange(n), np.arange(1, n + 1)
        self.bucket_of_row = owner
        while n and len(owner) > owner[-1] + 1 or len(self.levels) == 1 and n:
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            cuts = np.flatnonzero(place % FANOUT == 0)
            stops = np.r_[cuts[1:], len(owner)]
            all_of, any_of = np.bitwise_and.reduceat(all_of, cuts), np.bitwise_or.reduceat(any_of, cuts)
            start, end, owner = start[cuts], end[stops - 1], owner[cuts]
            mask = ~(all_of ^ any_of)
            self.levels.append((mask, all_of & mask, start, end, cuts, stops))
        #: Bits a node adds to what its parent has compared.
        self.added = [level[0].copy() for level in self.levels]
        for k in range(len(self.levels) - 1):
            upper = self.levels[k + 1]
            self.added[k] &= ~np.repeat(upper[0], upper[5] - upper[4])

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs that connect each row with every later row of its bucket within `radius` bits.

        A node taken whole is given as links to its first row, and from that row to its other rows.
        """
        sizes = np.bincount(self.bucket_of_row)[self.bucket_of_row]
        steps = np.cumsum(sizes)
        at = 0
        while at < len(self.codes):
            upto = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + PAIRS, "right")))
            yield from self._links(np.arange(at, upto), radius)
            at = upto

    def _links(self, rows: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        query, node, seen = rows, self.bucket_of_row[rows], np.zeros(len(rows), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            mask, pattern, start, end, first, stop = self.levels[k]
            seen = seen + np.bitwise_count((self.codes[query] ^ pattern[node]) & self.added[k][node])
            keep = (seen <= radius) & (end[node] > query + 1)
            query, node, seen = query[keep], node[keep], seen[keep]
            whole = seen + np.bitwise_count(~mask[node]) <= radius
            if whole.any():
                yield query[whole], start[node[whole]]
                for x in np.unique(node[whole]):
                    yield np.full(end[x] - start[x], start[x]), np.arange(start[x], end[x])
                query, node, seen = query[~whole], node[~whole], seen[~whole]
            if k:
                width = stop[node] - first[node]
                query, seen = np.repeat(query, width), np.repeat(seen, width)
                node = np.repeat(first[node] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest row of each group) after joining rows a with rows b."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, before[side], low)
        while (label != (up := label[label])).any():
            label = up
        if (label == before).all():
            return label


def _bucket_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """One edge per linked fingerprint, bucket by bucket; rows arrive with whole buckets together."""

    def solve(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        codes = fp.view(np.uint64)
        order = np.lexsort((gray_rank(codes), bucket))
        index = GrayIndex(bucket[order], codes[order])
        label = np.arange(len(order))
        for a, b in index.links(radius):
            label = merge(label, a, b)
        linked = np.flatnonzero(label != np.arange(len(order)))
        ids = fp[order]
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], ["src", "dst"])

    rest_b, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        rest_b = np.r_[rest_b, batch.column("bucket").to_numpy(zero_copy_only=False)]
        rest_f = np.r_[rest_f, batch.column("fp").to_numpy(zero_copy_only=False)]
        if len(rest_b) and (done := int(np.searchsorted(rest_b, rest_b[-1]))):
            yield solve(rest_b[:done], rest_f[:done])
            rest_b, rest_f = rest_b[done:], rest_f[done:]
    if len(rest_b):
        yield solve(rest_b, rest_f)


def edges(codes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(src, dst): edges that connect all distinct `fp` within `radius` bits, directly or through others."""
    blocks, keyed = radius + 1, []
    for t in range(blocks):
        low, high = t * 64 // blocks, (t + 1) * 64 // blocks
        keyed.append(F.struct(F.lit(t).alias("t"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << high - low) - 1)).alias("v")))
    dealt = codes.select("fp", F.explode(F.array(*keyed)).alias("k")).select("fp", "k.t", "k.v")
    large = (
        dealt.groupBy("t", "v").count().filter(F.col("count") > bucket_rows)
        .select("t", "v", F.ceil(F.col("count") / bucket_rows).cast("int").alias("chunks"))
    )
    one = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), one).cast("int")
    pair = F.transform(F.sequence(F.lit(0), one - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    split = dealt.join(large, ["t", "v"], "left").withColumn("own", own).select("fp", "t", "v", F.explode(pair).alias("p"))
    placed = split.select(F.xxhash64("t", "v", "p.i", "p.j").alias("bucket"), "fp")
    return (
        placed.repartition(tasks_for(codes.sparkSession), "bucket").sortWithinPartitions("bucket", "fp")
        .mapInArrow(lambda batches: _bucket_edges(batches, radius), "src bigint, dst bigint")
    )


def components(codes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, root): each fingerprint that is linked to another, and the smallest one of its group."""
    return traverse.components(cut(edges(codes, radius, bucket_rows))).select(F.col("id").alias("fp"), F.col("component").alias("root"))


def groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id): hex fingerprint and smallest doc_id reachable over links."""
    marked = cut(fingerprints(docs, width))
    codes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = codes.join(components(codes.select("fp"), radius, bucket_rows), "fp")
    lowest = member.groupBy("root").agg(F.min("first").alias("low"))
    named = member.join(lowest, "root").select("fp", "low")
    named = cut(codes.join(named, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id")))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row of `docs`, all columns, of each group: that of the smallest doc_id (a null one last), then text hash."""
    keyed = docs.withColumn("_key", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    marked = cut(fingerprints(keyed, width, ("doc_id", "_key")))
    roots = components(marked.select("fp").distinct(), radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "_key")).alias("first")
    kept = marked.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first._key").alias("_first"))
    one = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed["_key"] == kept["_first"]))
    return one.dropDuplicates(["doc_id", "_key"]).select(*docs.columns)
