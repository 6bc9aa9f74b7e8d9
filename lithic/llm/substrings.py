"""Removal of repeated substrings through Burrows-Wheeler transforms of content-addressed shards.

The unit is a window of LENGTH bytes. Of the hashed GRAM-byte strings in a window the smallest names the window, so equal
windows have equal names wherever they occur; neighbouring windows mostly share a name and form a run.

1. Documents are dealt into parts of about PART_BYTES. Every part sends the names it holds to buckets by name.
2. A bucket answers which names occur in more than one document, and which of them in more than HOT.
3. Parts send the distinct runs under such names, as bytes, to shards by name. A run under a hot name is sent as single
   windows, which are dealt out by their content, so no shard gathers all surroundings of a frequent string.
4. A shard joins its distinct runs, builds the transform, and expands intervals breadth first by backward steps: the
   boundary found at step l has a common prefix of l bytes. It stops at LENGTH; what lies between the
   boundaries are the classes of equal windows. Each class tells the smallest document that holds it.
5. Parts look up their runs and remove every byte under a window whose class starts in an earlier document.

Texts travel once; steps 1, 3 and 5 read the same shuffled parts. Equal runs of a chunk are sent once, and a part gets one answer for each.

Defined results: null is the empty text; texts under LENGTH bytes are kept; rows with the same doc_id do not remove each
other's bytes; rows without doc_id are kept whole and remove nothing; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import blobs

LENGTH, GRAM = 50, 24
PART_BYTES, CHUNK_BYTES, SHARD_BYTES, HOT = 4 << 20, 1 << 20, 2 << 20, 50_000
#: A run has at most LENGTH - GRAM + 1 windows, so its bytes are counted in one byte.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n, or more, of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) <= n:
        size = 1 << max(16, n.bit_length())
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)], dtype=np.uint64)
    return _POWERS


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; `substring_hash` turns two of its values into the hash of what lies between."""
    up, _ = _powers(len(data))
    return np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums) - 1)
    h = (sums[end] - sums[start]) * down[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Runs:
    """The runs of some texts laid end to end: first window, number of windows, name, and content hash of each."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        self.begin = ends - sizes
        self.sums = prefix_sums(self.data)
        n, width = len(self.data) - LENGTH + 1, LENGTH - GRAM + 1
        empty = np.zeros(0, np.int64)
        self.start, self.count, self.name, self.text = empty, empty, empty.astype(np.uint64), empty
        if n <= 0:
            return
        at = np.arange(len(self.data) - GRAM + 1)
        key = (substring_hash(self.sums, at, at + GRAM) >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
        span = 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = np.minimum(key[: n], key[width - span : width - span + n])
        text = np.repeat(np.arange(len(texts)), sizes)[:n]
        fits = np.arange(n) + LENGTH <= ends[text]
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (fits[1:] != fits[:-1]) | (text[1:] != text[:-1])])
        count = np.diff(np.r_[cuts, n])
        use = fits[cuts]
        self.start, self.count, self.text = cuts[use], count[use], text[cuts[use]]
        self.name = key[self.start] >> np.uint64(24)

    def content(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        return substring_hash(self.sums, self.start[which], self.start[which] + self.count[which] + LENGTH - 1)

    def windows(self, which: np.ndarray) -> Runs:
        """The windows of some runs, each a run of its own."""
        out = object.__new__(Runs)
        n = self.count[which]
        out.data, out.sums, out.begin = self.data, self.sums, self.begin
        out.start = ranges(self.start[which], n)
        out.count, out.name, out.text = np.ones(len(out.start), np.int64), np.repeat(self.name[which], n), np.repeat(self.text[which], n)
        return out

    def bytes_of(self, which: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The runs' bytes joined, and their sizes."""
        sizes = self.count[which] + LENGTH - 1
        return self.data[ranges(self.start[which], sizes)].tobytes(), sizes


def chunks(rows: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, Runs]]:
    """(row, offset, runs) of groups of texts; a long text is cut into chunks that overlap by one byte less than a window."""
    held, size = [], 0
    for row, (_, text) in enumerate(rows):
        for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK_BYTES):
            part = text[at : at + CHUNK_BYTES + LENGTH - 1]
            if held and size + len(part) > CHUNK_BYTES:
                yield np.array([h[0] for h in held]), np.array([h[1] for h in held]), Runs([h[2] for h in held])
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield np.array([h[0] for h in held]), np.array([h[1] for h in held]), Runs([h[2] for h in held])


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, joined."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def expand(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rotations of `text` (symbols 0 to 511) by their first `length` symbols, and which rows begin a new class of equal prefixes.

    The rows of an interval (all rotations that begin with some string) lead by one backward step to the intervals
    of the strings that are one symbol longer in front. Step l finds the boundaries between rows that share exactly l
    symbols, and only intervals that end at a new boundary are extended further.
    """
    n = len(text)
    key, depth = np.zeros(n, np.int64), 7
    for i in range(depth):
        key = key << 9 | np.roll(text, -i)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new, rows = np.r_[True, key[1:] != key[:-1]], np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)  # first row of the class of each rotation
    rank[order] = np.maximum.accumulate(np.where(new, rows, 0))
    while depth < length:
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))  # rows whose class is not single yet
        part = order[open_]
        key = rank[part].astype(np.int64) * n + rank[(part.astype(np.int64) + depth) % n]
        sort = np.argsort(key)
        key, order[open_] = key[sort], part[sort]
        new[open_[1:]] |= key[1:] != key[:-1]
        rank[order[open_]] = np.maximum.accumulate(np.where(new[open_], open_, 0))
        depth *= 2
    row_of = np.empty(n, np.int32)
    row_of[order] = rows
    back = row_of[order - 1]  # the row of the rotation that starts one symbol earlier
    first_symbol = text[order].astype(np.int16)
    boundary = np.zeros(n + 1, bool)
    boundary[[0, n]] = True
    low, high, owner_of = np.array([0]), np.array([n]), np.empty(n, np.int32)
    for _ in range(length):
        target = back[ranges(low, high - low)]
        owner_of[target] = np.repeat(np.arange(len(low), dtype=np.int32), high - low)
        target = np.sort(target)
        owner, symbol = owner_of[target], first_symbol[target]
        cuts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])])
        first, last = target[cuts].astype(np.int64), target[np.r_[cuts[1:], len(target)] - 1].astype(np.int64) + 1
        fresh = ~boundary[last]
        boundary[last[fresh]] = True
        low, high = first[fresh], last[fresh]
        if not len(low):
            break
    return order, boundary[:-1]


def first_documents(raw: np.ndarray, sizes: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """For each window of each piece (laid end to end in `raw`), in order, the smallest document among the pieces that hold it."""
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(len(raw) + len(sizes), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = raw.astype(np.int64) + 1
    order, new = expand(text, LENGTH)
    whole = np.arange(len(text)) + LENGTH <= ends[owner]
    group = np.cumsum(new) - 1
    smallest, real = np.full(group[-1] + 1, np.iinfo(np.int64).max), whole[order]
    np.minimum.at(smallest, group[real], documents[owner[order[real]]])
    at = np.empty(len(text), np.int64)
    at[order] = smallest[group]
    return at[whole]


# --- what the five steps send ---


def _rows_of(table: pa.Table) -> list[tuple[int, bytes]]:
    return [(d, t) for d, t in zip(table.column("doc_id").to_pylist(), blobs(table.column("text").combine_chunks()), strict=True)]


def _five(names: np.ndarray) -> np.ndarray:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _names(raw: bytes) -> np.ndarray:
    return np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 5), ((0, 0), (0, 3))).view("<u8").ravel()


def _dealt(keys: np.ndarray, ways: int) -> Iterator[tuple[int, np.ndarray]]:
    """(way, places) of keys grouped by remainder."""
    way = (keys % np.uint64(ways)).astype(np.int64)
    order = np.argsort(way, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(way[order]) > 0]) if len(order) else []
    for places in np.split(order, cuts[1:]) if len(order) else []:
        yield int(way[places[0]]), places


_ASKED = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("names", pa.binary()), ("seen", pa.binary())])
_SHARED = pa.schema([("part", pa.int64()), ("names", pa.binary()), ("hot", pa.binary())])
_SENT = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("size", pa.binary()), ("name", pa.binary()), ("bytes", pa.binary())])
_FOUND = pa.schema([("part", pa.int64()), ("hash", pa.binary()), ("name", pa.binary()), ("windows", pa.binary()), ("first", pa.binary())])
_DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
#: Marks the name of a run that is sent as single windows.
SINGLE = np.uint64(1 << 63)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(schema), schema=schema)


def _ask(table: pa.Table, buckets: int) -> pa.Table:
    part = table.column("part")[0].as_py()
    found = [runs.name for _, _, runs in chunks(_rows_of(table))]
    names, seen = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out = [(part, way, _five(names[at]).tobytes(), np.minimum(seen[at], 255).astype(np.uint8).tobytes()) for way, at in _dealt(names, buckets)]
    return _table(out, _ASKED)


def _answer(table: pa.Table) -> pa.Table:
    own = [_names(x) for x in table.column("names").to_pylist()]
    seen = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("seen").to_pylist()]).astype(np.int64)
    names, place = np.unique(np.concatenate(own), return_inverse=True)
    total = np.bincount(place, seen)
    out = []
    for part, mine, at in zip(table.column("part").to_pylist(), own, np.split(place, np.cumsum(list(map(len, own)))[:-1]), strict=True):
        many = total[at] > 1
        if many.any():
            out.append((part, _five(mine[many]).tobytes(), (total[at][many] > HOT).astype(np.uint8).tobytes()))
    return _table(out, _SHARED)


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _send(texts: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
    if not texts.num_rows or not answers.num_rows:
        return _table([], _SENT)
    part, rows = texts.column("part")[0].as_py(), _rows_of(texts)
    names, hot = _names(b"".join(answers.column("names").to_pylist())), _joined(answers, "hot", np.uint8) > 0
    order = np.argsort(names)
    names, hot = names[order], hot[order]
    documents = np.array([d for d, _ in rows], np.int64)
    out = []
    for row, _, runs in chunks(rows):
        at = np.minimum(np.searchsorted(names, runs.name), len(names) - 1)
        shared = names[at] == runs.name
        for group, some in ((runs, np.flatnonzero(shared & ~hot[at])), (runs.windows(np.flatnonzero(shared & hot[at])), None)):
            some = np.arange(len(group.start)) if some is None else some
            content, doc = group.content(some), documents[row[group.text[some]]]
            once, first, back = np.unique(content, return_index=True, return_inverse=True)
            low, high = np.full(len(once), np.iinfo(np.int64).max), np.full(len(once), np.iinfo(np.int64).min)
            np.minimum.at(low, back, doc)
            np.maximum.at(high, back, doc)
            single = group is not runs
            for way, mine in _dealt(once if single else group.name[some[first]], shards):
                raw, size = group.bytes_of(some[first[mine]])
                name = group.name[some[first[mine]]] | SINGLE if single else np.zeros(len(mine), np.uint64)
                out.append((part, way, low[mine].tobytes(), high[mine].tobytes(), size.astype(np.uint8).tobytes(), name.tobytes(), raw))
    return _table(out, _SENT)


def _solve(table: pa.Table) -> pa.Table:
    low, high, size = _joined(table, "low", np.int64), _joined(table, "high", np.int64), _joined(table, "size", np.uint8).astype(np.int64)
    name, raw = _joined(table, "name", np.uint64), _joined(table, "bytes", np.uint8)
    ends = np.cumsum(size)
    content = substring_hash(prefix_sums(raw), ends - size, ends)
    _, pick, back = np.unique(content, return_index=True, return_inverse=True)
    smallest = np.full(len(pick), np.iinfo(np.int64).max)
    np.minimum.at(smallest, back, low)
    firsts = first_documents(raw[ranges((ends - size)[pick], size[pick])], size[pick], smallest)
    windows = size[pick] - LENGTH + 1
    piece = np.repeat(np.arange(len(pick)), windows)
    lowest = np.minimum.reduceat(firsts, np.cumsum(windows) - windows)
    cuts = np.flatnonzero(np.r_[True, (firsts[1:] != firsts[:-1]) | (piece[1:] != piece[:-1])])
    width, value = np.diff(np.r_[cuts, len(firsts)]), firsts[cuts]
    run_at = np.searchsorted(piece[cuts], np.arange(len(pick) + 1))
    # a part sends a run once for each of its chunks and gets one answer
    rows = [len(x) // 8 for x in table.column("low").to_pylist()]
    part = np.repeat(np.array(table.column("part").to_pylist(), np.int64), rows)
    asked = np.flatnonzero(lowest[back] < high)
    _, one = np.unique(part[asked] * len(pick) + back[asked], return_index=True)
    asked, out = asked[one], []
    for mine in np.split(asked, np.flatnonzero(np.diff(part[asked])) + 1) if len(asked) else ():
        n = run_at[back[mine] + 1] - run_at[back[mine]]
        at = ranges(run_at[back[mine]], n)
        out.append((int(part[mine[0]]), np.repeat(content[mine], n).tobytes(), np.repeat(name[mine], n).tobytes(), width[at].astype(np.uint8).tobytes(), value[at].tobytes()))
    return _table(out, _FOUND)


def _remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
    rows = _rows_of(texts) if texts.num_rows else []
    documents = np.array([d for d, _ in rows], np.int64)
    hashes, name, width, value = (_joined(answers, c, k) for c, k in (("hash", np.uint64), ("name", np.uint64), ("windows", np.uint8), ("first", np.int64)))
    hot = np.unique(name[name >= SINGLE] - SINGLE)
    order = np.argsort(hashes, kind="stable")
    hashes, width, value = hashes[order], width[order].astype(np.int64), value[order]
    spans = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for row, offset, runs in chunks(rows) if len(hashes) else ():
        single = np.isin(runs.name, hot)
        for group, some in ((runs, np.flatnonzero(~single)), (runs.windows(np.flatnonzero(single)), slice(None))):
            content, start, text = group.content(some), group.start[some], group.text[some]
            lo = np.searchsorted(hashes, content)
            n = np.searchsorted(hashes, content, "right") - lo
            entry, run = ranges(lo, n), np.repeat(np.arange(len(n)), n)
            ahead = np.cumsum(width[entry]) - width[entry]
            ahead -= ahead[(np.cumsum(n) - n)[run]]
            text = text[run]
            gone = value[entry] < documents[row[text]]
            at = start[run] + ahead - runs.begin[text] + offset[text]
            spans.append((row[text][gone], at[gone], (at + width[entry] + LENGTH - 1)[gone]))
    row, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    far = np.int64(max([0, *(len(t) for _, t in rows)]) + 1)
    sort = np.argsort(row * far + start, kind="stable")
    row, start, end = row[sort], start[sort], end[sort]
    reach = np.maximum.accumulate(row * far + end)
    cuts = np.flatnonzero(np.r_[True, (row * far + start)[1:] > reach[:-1]]) if len(row) else np.zeros(0, np.int64)
    stops = reach[np.r_[cuts[1:], len(row)] - 1] if len(row) else cuts
    first = np.searchsorted(row[cuts], np.arange(len(rows) + 1))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        gaps = list(zip(start[cuts[first[i] : first[i + 1]]].tolist(), (stops[first[i] : first[i + 1]] - i * far).tolist(), strict=True))
        kept, at = hashlib.sha256(), 0
        for s, e in gaps:
            kept.update(text[at:s])
            at = e
        kept.update(text[at:])
        out.append((doc_id, len(text), sum(e - s for s, e in gaps), len(gaps), kept.hexdigest(), [x for gap in gaps for x in gap]))
    return _table(out, _DONE)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def deduplicate(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): what is removed from each row's text; spans lists starts and ends in bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // part_bytes
    known = rows.filter("doc_id is not null")
    texts = known.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("part"))
    asked = texts.groupBy("part").applyInArrow(lambda t: _ask(t, parts), _ddl(_ASKED))
    shared = asked.groupBy("bucket").applyInArrow(_answer, _ddl(_SHARED))
    sent = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(lambda t, a: _send(t, a, 2 * parts), _ddl(_SENT))
    found = sent.groupBy("shard").applyInArrow(_solve, _ddl(_FOUND))
    done = texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_remove, _ddl(_DONE))
    whole = rows.filter("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<long>").alias("spans"),
    )
    return done.unionByName(whole)
