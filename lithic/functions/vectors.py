"""Hashed bag-of-token vectors computed row by row.

A vector lives in the row of its text, so indexing and searching need no shuffle: bucket counts
are integers, the dot product of two count vectors is an exact integer, and only the final
division is floating point. Texts are cut into tokens and hashed by an Arrow function over whole
batches; what follows works on the at most `DIM` counts of a text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 512
#: Text looked at together inside a batch, in bytes.
SLICE_BYTES = 2 << 20
# Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK32 = 0xFFFFFFFF


def fnv1a(token: Column) -> Column:
    """Unsigned 32-bit FNV-1a of an ASCII token, as a long."""
    return F.aggregate(
        F.split(token, ""),
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, ch: F.when(ch == "", h).otherwise(
            (h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(
                F.lit(MASK32).cast("long")
            )
        ),
    )


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries per text, bucket, count) of lower-case texts laid end to end, buckets ascending within a text.

    Tokens are alphanumeric runs plus their parts at digit boundaries, 2 to 30 characters long.
    """
    kind = ((data >= 97) & (data <= 122)).astype(np.int8) + 2 * ((data >= 48) & (data <= 57)).astype(np.int8)
    border = np.zeros(len(data) + 1, bool)  # no token goes on from one text to the next
    border[offsets] = True
    changes = np.flatnonzero(border | (np.diff(kind, prepend=0, append=0) != 0))
    start, end = changes[:-1], changes[1:]  # stretches of letters, of digits, or of anything else
    word = kind[start] > 0
    part_start, part_end = start[word], end[word]
    joined = np.r_[False, (part_end[:-1] == part_start[1:]) & ~border[part_start[1:]]][: len(part_start)]  # goes on in the same run
    first = np.flatnonzero(~joined)
    size = np.diff(np.r_[first, len(part_start)])  # parts of each run
    mixed = np.repeat(size > 1, size)
    start = np.r_[part_start[first], part_start[mixed]]
    end = np.r_[part_end[np.r_[first[1:], len(part_start)] - 1] if len(first) else part_end, part_end[mixed]]
    fits = (end - start >= 2) & (end - start <= 30)
    start, length = start[fits], (end - start)[fits]
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    h = np.full(len(start), FNV_OFFSET, np.uint64)
    for i in range(30):
        n = int(np.searchsorted(-length, -i, "left"))  # tokens longer than i come first
        h[:n] = ((h[:n] ^ data[start[:n] + i]) * np.uint64(FNV_PRIME)) & np.uint64(MASK32)
    text = np.searchsorted(offsets, start, "right") - 1
    key, n = np.unique(text * DIM + (h % np.uint64(DIM)).astype(np.int64), return_counts=True)
    return np.bincount(key // DIM, minlength=len(offsets) - 1), key % DIM, n


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])))
def _bucket_counts(lowered: pa.Array) -> pa.Array:
    """Looks at `SLICE_BYTES` of text at a time, one text at least."""
    lowered = lowered.cast(pa.large_binary())
    bytes_ = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    sizes, found, at = [np.zeros(0, np.int64)], [], 0
    while at < len(lowered):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        size, *entries = _counts(bytes_[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        sizes.append(size)
        found.append(entries)
        at = to
    values = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 2
    entries = pa.StructArray.from_arrays([pa.array(values[0], pa.int32()), pa.array(values[1], pa.int64())], ["bucket", "n"])
    ends = np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32)
    mask = pc.is_null(lowered) if lowered.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, mask=mask)


def buckets(text: Column) -> Column:
    """(bucket, n) of every bucket that a text's tokens fall in, ascending; at most DIM entries. Null for a null text."""
    return _bucket_counts(F.lower(text))


def squared_norm(counts: Column) -> Column:
    """Sum of the squared bucket counts."""
    return F.aggregate(counts, F.lit(0).cast("long"), lambda sq, b: sq + b["n"] * b["n"])


def count_map(counts: Column) -> Column:
    """map<bucket, count> of one text (at most DIM entries)."""
    return F.map_from_entries(counts)


def dot_with(counts: Column, query_counts: Column) -> Column:
    """Exact integer dot product of a text's counts with a query's bucket counts."""
    return F.aggregate(
        counts,
        F.lit(0).cast("long"),
        lambda acc, b: acc + b["n"] * F.coalesce(F.element_at(query_counts, b["bucket"]), F.lit(0).cast("long")),
    )


def dense_dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def query_counts(query: str) -> dict[int, int]:
    """Bucket counts of one short query string, for use as a literal."""
    found: list[str] = []
    for run in filter(None, re.split("[^a-z0-9]+", query.lower())):
        parts = re.findall("[a-z]+|[0-9]+", run)
        found += [run] + (parts if len(parts) > 1 else [])
    counts: Counter[int] = Counter()
    for token in found:
        if 2 <= len(token) <= 30:
            h = FNV_OFFSET
            for byte in token.encode("ascii"):
                h = ((h ^ byte) * FNV_PRIME) & MASK32
            counts[h % DIM] += 1
    return dict(counts)
