"""One of each group of near copies: SimHash and banded shingle hashes find candidates, Jaccard similarity of the shingle sets decides.

1. A text is the set of its hashed WIDTH-word shingles (lower case). Texts with equal sets are one node from here on.
2. Candidates come from two sides. The SimHash fingerprints of the texts, over the same shingles, go through the Gray-order index of `simhash`,
   which links all within its radius. What is further apart than such a radius can be told from is found by cells: each node has MINIMA
   minima of its set under different hash functions, and KEYS fixed choices of ROWS minima make a cell key each. At similarity 0.8 two nodes
   share a cell with probability 0.997, at 0.5 with 0.17, at 0.3 with 0.003, so texts that share a passage only do not meet.
3. Members of a cell are tied to its smallest node, first within tasks and then over them; what hangs together is a cluster.
4. Clusters are dealt into slices and their sets compared as in `setjoin`: no pairs leave a task but those that join two groups.
   A candidate is a link if the similarity of its sets is PERCENT hundredths at least. Groups are the components over links.

Defined results: null and blank texts have the empty set and are one node; texts of fewer words than a shingle are one shingle;
a group keeps all columns of the row with the smallest doc_id (a null one last), then text hash; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm import setjoin, simhash
from lithic.llm.common import strings, text_slices
from lithic.operators import traverse
from lithic.session import cut

WIDTH, PERCENT, SEED = 5, 80, 42
#: Minima of a set, and the cells made of them.
MINIMA, KEYS, ROWS = 128, 48, 8
#: Values of a block of minima.
BLOCK = 1 << 18
_RANDOM = np.random.default_rng(SEED)
_MASK, _FACTOR = _RANDOM.integers(1, 1 << 63, (2, MINIMA, 1), dtype=np.uint64) | np.uint64(1)
_CHOSEN = np.array([_RANDOM.permutation(MINIMA)[:ROWS] for _ in range(KEYS)])
_STEP = _RANDOM.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def cells(own: np.ndarray) -> np.ndarray:
    """A key for each choice of minima; none for the empty set."""
    if not len(own):
        return np.zeros(0, np.uint64)
    least = np.full(MINIMA, simhash.FULL)
    for at in range(0, len(own), BLOCK // MINIMA):
        h = (own[None, at : at + BLOCK // MINIMA] ^ _MASK) * _FACTOR
        h ^= h >> np.uint64(32)
        least = np.minimum(least, h.min(axis=1))
    return setjoin.mixed((setjoin.mixed(least[_CHOSEN]) * _STEP).sum(axis=1, dtype=np.uint64) + np.arange(KEYS, dtype=np.uint64))


def close_prints(rows: DataFrame) -> DataFrame:
    """(src, dst): ties of nodes whose fingerprints, rows of (node, fp), are equal or linked by the Gray-order index."""
    first = cut(rows.groupBy("fp").agg(F.min("node").alias("low"), F.max("node").alias("high")))
    equal = rows.join(first.filter("low <> high"), "fp").filter("node <> low").select(F.col("node").alias("src"), F.col("low").alias("dst"))
    of = lambda end: first.select(F.col("fp").alias(end), F.col("low").alias(f"{end}_node"))
    near = cut(simhash.edges(first.select("fp"))).join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    return equal.unionByName(near)


def components(members: DataFrame, slice_sets: int = setjoin.SLICE_SETS) -> DataFrame | None:
    """(id, component) of the nodes that have links, from rows of (node, cluster, own); none if there is no link."""
    return setjoin.linked(members, PERCENT, slice_sets)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and fingerprint of each text."""
    for batch in text_slices(batches):
        texts = [t.encode() for t in strings(batch.column("text"))]
        node = [setjoin.node_of(setjoin.shingles(t, WIDTH)) for t in texts]
        fp = np.array([simhash.simhash(t, WIDTH) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), pa.array(node, pa.int64()), pa.array(fp)], ["doc_id", "_key", "node", "fp"])


def representatives(docs: DataFrame, slice_sets: int = setjoin.SLICE_SETS) -> DataFrame:
    """One row of `docs`, all columns, of each group."""
    keyed = docs.withColumn("_key", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    texts = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "_key", F.col("text").cast("string").alias("text"))
    named = cut(texts.mapInArrow(_named, "doc_id long, _key string, node long, fp long"))
    order = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "_key")
    nodes = cut(named.groupBy("node").agg(F.min(order).alias("first"), F.min("fp").alias("fp")))
    met = cut(setjoin.sketches(texts.select("doc_id", "text"), WIDTH, cells).filter("size is null"))
    ties = setjoin.stars(met).unionByName(close_prints(nodes.select("node", "fp")))
    cluster = cut(setjoin.clusters(ties))
    holder = cut(cluster.join(nodes, "node").select("node", "cluster", F.col("first.doc_id").alias("doc_id")))
    members = cut(holder.join(setjoin.sets_of(texts, holder, WIDTH), "node").dropDuplicates(["node"]).select("node", "cluster", "own"))
    groups = components(members, slice_sets)
    member = nodes.select("node", "first")
    member = member.withColumn("root", F.col("node")) if groups is None else member.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("component", "node"))
    kept = member.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first._key").alias("_first"))
    rest = cut(member.join(kept, (F.col("first.doc_id").eqNullSafe(F.col("_id"))) & (F.col("first._key") == F.col("_first"))).select("_id", "_first"))
    return one_each(keyed, rest, docs.columns)


def one_each(keyed: DataFrame, kept: DataFrame, columns: list[str]) -> DataFrame:
    """One whole row of `keyed` for each (_id, _first) of `kept`; rows that are equal in both are one."""
    one = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed["_key"] == kept["_first"]))
    return one.dropDuplicates(["doc_id", "_key"]).select(*columns)
