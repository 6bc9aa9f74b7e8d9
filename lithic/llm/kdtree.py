"""Exact top-k search by inner product over KD-trees, one per shard.

* Rows are dealt evenly into shards of about SHARD_ROWS. A shard is split at the median of its widest dimension until
  LEAF rows are left; every node keeps the tight box of its rows.
* No row of a box can score more than the sum over dimensions of max(q * low, q * high). A query visits nodes best
  bound first and stops when the bound falls below its kth score.
* A query first searches the shard it lives in. Its kth score there goes with it to all other shards, so most of
  their nodes are never opened. Query blocks go to the shards, not the shards to the queries.

Components are floor(SCALE * x) of x as double; scores are exact integers (computed with arbitrary precision where doubles could
round, and held within the range of long). Defined results: vectors that are null or hold null or non-finite
components take no part; shorter vectors count as padded with zeros; a row is never its own candidate, but another row
with the same id is; a row without vec_id is a candidate and, if `asks` holds for it, a query, and comes last in ties (inside, it stands as the
largest long, so a vec_id of that value reads as null); extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.session import cut

SCALE, SHARD_ROWS, LEAF, BLOCK = 1024, 16384, 128, 512
EXACT = 2.0**53
#: Stands for a missing vec_id.
NO_ID = 2**63 - 1


def dots(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued doubles."""
    if rows.size and np.abs(rows).max() * np.abs(query).max() * rows.shape[1] >= EXACT:
        exact = [sum(int(a) * int(b) for a, b in zip(r, query, strict=True)) for r in rows]
        return np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], np.int64)
    return (rows @ query).astype(np.int64)


class Tree:
    def __init__(self, rows: np.ndarray):
        self.order = np.arange(len(rows))
        lows, highs, self.span, self.kids = [], [], [], []
        todo = [(0, len(rows), -1)]
        while todo:
            start, end, parent = todo.pop()
            me = len(self.span)
            part = rows[self.order[start:end]]
            lows.append(part.min(0))
            highs.append(part.max(0))
            self.span.append((start, end))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(me)
            if end - start > LEAF:
                middle = (end - start) // 2
                widest = int((highs[-1] - lows[-1]).argmax())
                self.order[start:end] = self.order[start:end][np.argpartition(part[:, widest], middle)]
                todo += [(start, start + middle, me), (start + middle, end, me)]
        self.rows, self.low, self.high = rows[self.order], np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no row of the node scores more."""
        up = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        sure = np.abs(queries).max(1, initial=0) * np.maximum(np.abs(self.low), np.abs(self.high)).max() * queries.shape[1] < EXACT
        return np.where(sure[:, None], up, np.inf)

    def best(self, query: np.ndarray, bounds: np.ndarray, ids: np.ndarray, k: int, kth: int, own: int = -1) -> list[tuple[int, int, int]]:
        """The k best (score, -id, place) that reach `kth`; `own` is the place of the query itself."""
        found: list[tuple[int, int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bounds[kid] >= kth:
                        heapq.heappush(heap, (-bounds[kid], kid))
                continue
            start, end = self.span[node]
            score = dots(self.rows[start:end], query)
            places = self.order[start:end]
            for i in np.flatnonzero((score >= kth) & (places != own)):
                item = int(score[i]), -int(ids[places[i]]), int(places[i])
                if len(found) < k:
                    heapq.heappush(found, item)
                elif item > found[0]:
                    heapq.heapreplace(found, item)
            if len(found) == k:
                kth = max(kth, found[0][0])
        return sorted(found, reverse=True)


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): scaled integer components, as doubles, of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: x * float(SCALE))
    return vectors.filter(v.isNotNull() & fine).select("vec_id", F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)).alias("v"))


_PACKED = "shard int, block int, dim int, ids binary, places binary, vectors binary, kth binary"


def _packed(shard: int, block: int, rows: np.ndarray, ids: np.ndarray, places: np.ndarray, kth: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([rows.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, places, rows, kth))]
    return pa.RecordBatch.from_arrays(columns, ["shard", "block", "dim", "ids", "places", "vectors", "kth"])


def _pack(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each shard as one row (block -1), and its queries as blocks with the kth score found at home."""

    def close(shard: int, ids: list[int], vectors: list[list[float]], asks: list[bool]) -> Iterator[pa.RecordBatch]:
        dim = max(1, *map(len, vectors))
        rows = np.zeros((len(vectors), dim))
        for i, v in enumerate(vectors):
            rows[i, : len(v)] = v
        keys, places = np.array(ids, np.int64), np.arange(len(ids))
        yield _packed(shard, -1, rows, keys, places, np.zeros(0, np.int64))
        tree, wanted = Tree(rows), np.flatnonzero(asks)
        for b, at in enumerate(range(0, len(wanted), BLOCK)):
            own = wanted[at : at + BLOCK]
            home = [tree.best(rows[p], bound, keys, k, -(2**63), p) for p, bound in zip(own, tree.bounds(rows[own]), strict=True)]
            kth = np.array([f[-1][0] if len(f) == k else -(2**63) for f in home], np.int64)
            yield _packed(shard, b, rows[own], keys[own], own, kth)

    shard, held = None, ([], [], [])
    for batch in batches:
        for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "vec_id", "v", "asks")), strict=True):
            if s != shard and held[0]:
                yield from close(shard, *held)
                held = ([], [], [])
            shard = s
            for part, x in zip(held, row, strict=True):
                part.append(x)
    if held[0]:
        yield from close(shard, *held)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each shard row followed by the query blocks sent to it: the candidates of each query in the shard."""
    tree, here, keys, dim = None, None, None, 0
    for batch in batches:
        for r in batch.to_pylist():
            rows = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
            ids, places = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["places"], np.int64)
            if r["block"] < 0:
                tree, here, keys, dim = Tree(rows), r["shard"], ids, r["dim"]
                continue
            queries = np.zeros((len(rows), dim))
            queries[:, : min(dim, r["dim"])] = rows[:, :dim]
            out = []
            for q, bound, query_id, place, kth in zip(queries, tree.bounds(queries), ids, places, np.frombuffer(r["kth"], np.int64), strict=True):
                own = int(place) if r["home"] == here else -1
                out += [(r["home"], int(place), int(query_id), -minus, score) for score, minus, _ in tree.best(q, bound, keys, k, int(kth), own)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)], ["home", "place", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, asks: Column, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for which `asks` holds."""
    spark, rows = vectors.sparkSession, whole(vectors)
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = rows.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), "v", F.coalesce(asks, F.lit(False)).alias("asks")
    )
    packed = cut(dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "vec_id").mapInArrow(lambda b: _pack(b, k), _PACKED))
    trees = packed.filter("block < 0").withColumn("home", F.col("shard"))
    blocks = packed.filter("block >= 0").withColumn("home", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    reached = blocks.join(trees.select("shard"), "shard", "left_semi")
    sent = trees.unionByName(reached.select(*trees.columns)).repartitionById(shards, "shard").sortWithinPartitions("shard", "block", "home")
    found = sent.mapInArrow(lambda b: _search(b, k), "home int, place long, query_id long, vec_id long, score long")
    best = Window.partitionBy("home", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        F.nullif("query_id", F.lit(NO_ID)).alias("query_id"), "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score"
    )


SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 10
"""
