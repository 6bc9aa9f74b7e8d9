"""Jaccard join of word n-gram sets by T-occurrence search.

Two sets link when their intersection has at least PERCENT hundredths of their union. Equal sets are one node from here on.

1. Candidates, without losing a link: sets of a size class are cut into more parts (by ranges of their hashes) than linked sets can have
   differing members, so linked sets agree on a part. Each part's hash is a cell. One part of slack for each
   empty part that is to be expected means that empty parts need no cell; a set with more of them is cut again under another seed. Cells
   hold about eight members, so texts that only share a line or a phrase do not meet.
2. Members of a cell are tied to its smallest node, a star instead of all pairs, first within tasks and then over them; what hangs together is a cluster. A cluster is one slice,
   or several if its sets are many or large, so no task holds more than a slice.
3. Inside a slice inverted lists (member: sets that hold it) answer T-occurrence queries. For a query of size b a linked set holds at least
   T of its members. DivideSkip puts the longest lists aside, merges the short ones on a heap, skipping ahead by binary search, and looks
   candidates up in the long lists by binary search until T is reached or out of reach. A candidate that is already in the group of the query is not looked up.
4. Clusters of several slices: first the sets with most candidates of each slice query the other slices, which joins what
   belongs together; then every set outside the largest group of its cluster does. Two sets of different groups cannot both be in the largest, so no link is lost.
5. Groups are the components over links.

Sets are known by 64-bit hashes of their members, nodes by a 64-bit hash of their set.

Defined results: null and blank texts have the empty set and link with nothing; texts of fewer words than an n-gram are one
n-gram; repeated rows are kept; a null doc_id never names a component unless all its members are null; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.llm.common import blobs, tasks_for, text_slices
from lithic.operators import traverse
from lithic.session import cut, cut_counted

WIDTH, PERCENT, SEED = 3, 90, 42
#: Sets, and members of all its sets, of a slice.
SLICE_SETS, SLICE_MEMBERS = 1024, 1 << 21
#: Sets of a slice that query the others first.
HUBS = 16
#: Cells that a task holds before it ties those that are equal.
CELLS = 1 << 22
#: Cost of a step on the heap by that of a look-up, for the number of long lists.
WEIGHT = 0.0085
#: Ratio of size classes, and seeds under which a set with many empty parts is cut before empty parts count.
RATIO, SEEDS = 1.5, 5
_STEP, _B = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The set of hashed word n-grams (lower case), ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in map(b" ".join, grams)), np.uint64))


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _B
    return x ^ x >> np.uint64(29)


@cache
def classes(percent: int) -> list[tuple[int, int, int]]:
    """(smallest size, parts, slack) by size class; no parts where only equal sets link."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low + 1, int(low * RATIO))
        differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
        empty = (differ + 2) * math.exp(-low / (differ + 2))
        slack = math.ceil(empty + 3 * math.sqrt(empty)) if empty > 0.1 else 1
        out.append((low, differ + 1 + slack if differ else 0, slack))
        low = high
    return out


@cache
def _bounds(percent: int) -> list[int]:
    return [c[0] for c in classes(percent)]


def cells(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys such that linked sets that are not equal share one."""
    n, bounds = len(own), _bounds(percent)
    at = bisect_left(bounds, n + 1) - 1
    found = [np.zeros(0, np.uint64)]
    for c in (at, at + 1):
        low, parts, slack = classes(percent)[c] if n else (0, 0, 0)
        if not parts or (c > at and 100 * n < percent * low):
            continue
        for seed in range(SEEDS):
            hashes = np.sort(mixed(own + np.uint64(seed * _STEP % (1 << 64)))) if seed else own
            total = np.r_[np.uint64(0), np.cumsum(mixed(hashes), dtype=np.uint64)]
            edge = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
            sums = total[edge[1:]] - total[edge[:-1]]
            filled = edge[1:] > edge[:-1]
            key = mixed(sums + mixed(np.arange(parts, dtype=np.uint64) + np.uint64((c * SEEDS + seed) << 40)))
            bad = int((~filled).sum()) > slack
            found.append(key if bad and seed == SEEDS - 1 else key[filled])
            if not bad:
                break
    return np.concatenate(found)


class Lists:
    """Inverted lists over sets that are added by ascending size."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, members: list[int]) -> None:
        i = len(self.sizes)
        for x in members:
            self.lists.setdefault(x, []).append(i)
        self.sizes.append(len(members))

    def search(self, members: list[int], skip: Callable[[int], bool]) -> Iterator[int]:
        """Places of the sets that link with `members`; a set is left out if `skip` says so when its turn comes."""
        p, b = self.percent, len(members)
        low, high = bisect_left(self.sizes, -(-p * b // 100)), bisect_left(self.sizes, 100 * b // p + 1)
        need = -(-p * b // 100)
        if low >= high:
            return
        lists = sorted((x for m in members if (x := self.lists.get(m)) and x[-1] >= low), key=len)
        if len(lists) < need:
            return
        aside = min(need - 1, int(need / (WEIGHT * math.log2(len(lists[-1])) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        least = need - aside
        heap = []
        for k, x in enumerate(short):
            if (at := bisect_left(x, low)) < len(x):
                heap.append((x[at], k, at))
        heapq.heapify(heap)
        while len(heap) >= least:
            i = heap[0][0]
            if i >= high:
                return
            same = []
            while heap and heap[0][0] == i:
                same.append(heapq.heappop(heap))
            ahead = i + 1
            if len(same) >= least:
                if not skip(i):
                    enough = -(-p * (b + self.sizes[i]) // (100 + p))
                    count, left = len(same), len(long)
                    for x in reversed(long):
                        if count >= enough or count + left < enough:
                            break
                        at, left = bisect_left(x, i), left - 1
                        count += at < len(x) and x[at] == i
                    if count >= enough:
                        yield i
            else:
                # what is left holds too few lists for anything before the next top
                while heap and len(same) < least - 1:
                    same.append(heapq.heappop(heap))
                if not heap:
                    return
                ahead = heap[0][0]
            for _, k, at in same:
                x = short[k]
                if (at := bisect_left(x, ahead, at)) < len(x):
                    heapq.heappush(heap, (x[at], k, at))


class Groups:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def within(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[list[tuple[int, int]], list[int]]:
    """(links that connect what belongs together, the sets with most candidates) of a slice."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    lists, groups, seen, links = Lists(percent), Groups(len(sets)), [0] * len(sets), []
    for place, i in enumerate(order):
        members = sets[i].tolist()

        def skip(j: int, place: int = place) -> bool:
            seen[j] += 1
            seen[place] += 1
            return groups.root(j) == groups.root(place)

        for j in lists.search(members, skip):
            groups.join(place, j)
            links.append((order[j], i))
        lists.add(members)
    first = {groups.root(k): k for k in sorted(range(len(order)), key=seen.__getitem__)}  # of each group the one with most
    hubs = sorted(range(len(order)), key=lambda k: -seen[k])[:HUBS] + sorted(first.values(), key=lambda k: -seen[k])[:HUBS]
    return links, sorted({order[k] for k in hubs})


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with the same `slice`, which follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("slice").to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column("slice")[0].as_py() != keys[s]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


_LINK = "slice long, src long, dst long"


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([],) * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slice", "src", "dst"])


def _within(percent: int) -> Callable:
    """Links of each slice; a hub is a link with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            key, node = table.column("slice")[0].as_py(), table.column("node").to_pylist()
            links, hubs = within(_arrays(table.column("own")), percent)
            yield _links([(key, node[i], node[j]) for i, j in [*links, *((h, h) for h in hubs)]])

    return run


def _across(percent: int) -> Callable:
    """Links of the queries (rows with `asks`) that came to a slice with its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            node, group, asks = (table.column(c).to_pylist() for c in ("node", "group", "asks"))
            sets = _arrays(table.column("own"))
            order = sorted((i for i in range(len(sets)) if not asks[i]), key=lambda i: (len(sets[i]), node[i]))
            lists, out = Lists(percent), []
            for i in order:
                lists.add(sets[i].tolist())
            met: set[tuple[int, int]] = set()
            for q in (i for i in range(len(sets)) if asks[i]):
                same = lambda j, q=q: group[order[j]] == group[q] or (group[q], group[order[j]]) in met
                for j in lists.search(sets[q].tolist(), same):
                    met.add((group[q], group[order[j]]))
                    out.append((0, node[order[j]], node[q]))
            yield _links(out)

    return run


def stars(marked: DataFrame) -> DataFrame:
    """(src, dst): ties of the members of each cell with its smallest node, from the rows of `_sketches`.

    A cell has one row per task and CELLS cells at most, as tasks have tied their own members already.
    """
    low = F.min("node").over(Window.partitionBy("cell"))
    shared = marked.select(F.explode("cells").alias("cell"), "node").withColumn("low", low).filter("node <> low")
    own = marked.filter("tie is not null").select(F.col("node").alias("src"), F.col("tie").alias("dst"))
    return shared.select(F.col("node").alias("src"), F.col("low").alias("dst")).unionByName(own).distinct()


def clusters(ties: DataFrame) -> DataFrame:
    """(node, cluster) of what hangs together."""
    return traverse.components(ties).select(F.col("id").alias("node"), F.col("component").alias("cluster"))


def linked(members: DataFrame, percent: int = PERCENT, slice_sets: int = SLICE_SETS, slice_members: int = SLICE_MEMBERS) -> DataFrame | None:
    """(id, component) of the nodes with links among `members` (node, cluster, own); none if there is no link."""
    spark = members.sparkSession
    weight = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.octet_length("own")).alias("bytes"))
    many = F.greatest(F.ceil(F.col("sets") / slice_sets), F.ceil(F.col("bytes") / (8 * slice_members))).cast("long")
    large = cut(weight.select("cluster", many.alias("slices")).filter("slices > 1"))
    number = lambda at: F.xxhash64("cluster", at)
    zero = F.lit(0).cast("long")
    dealt = members.join(large, "cluster", "left").withColumn("at", F.when(F.col("slices").isNull(), zero).otherwise(F.pmod(F.xxhash64("node"), "slices"))).withColumn("slice", number("at"))
    by_slice = lambda df: df.repartition(tasks_for(spark), "slice").sortWithinPartitions("slice", "node")
    found, n = cut_counted(by_slice(dealt.select("slice", "node", "own")).mapInArrow(_within(percent), _LINK))
    links = found.filter("src <> dst").select("src", "dst")
    if large.isEmpty():
        return None if not n or links.isEmpty() else cut(traverse.components(links))
    held = cut(dealt.filter("slices is not null").select("slice", "at", "slices", "cluster", "node", "own"))
    others = F.explode(F.filter(F.sequence(zero, F.col("slices") - 1), lambda i: i != F.col("at")))
    for last in (False, True):
        groups = cut(traverse.components(links)).withColumnRenamed("id", "node")
        marked = held.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
        if last:
            sizes = marked.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("size"))
            main = sizes.groupBy("cluster").agg(F.max_by("group", F.struct("size", "group")).alias("main"))
            asking = marked.join(main, "cluster").filter("group <> main").drop("main")
        else:
            asking = marked.join(found.filter("src = dst").select(F.col("src").alias("node")), "node", "left_semi")
        asking = asking.withColumn("to", others).withColumn("slice", number("to"))
        both = marked.select("slice", "node", "own", "group", F.lit(False).alias("asks")).unionByName(asking.select("slice", "node", "own", "group", F.lit(True).alias("asks")))
        links = links.unionByName(cut(by_slice(both).mapInArrow(_across(percent), _LINK)).select("src", "dst"))
    return None if links.isEmpty() else cut(traverse.components(links))


#: Columns of a row of a document, of a tie of two nodes, or of the cells that a node stands for in its task.
_SKETCH = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("tie", pa.int64()), ("cells", pa.list_(pa.int64()))])
SKETCH = "doc_id long, node long, size long, tie long, cells array<long>"


def _met(node: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    """Of each cell its smallest node stands for it; the others are tied to that node."""
    order = np.lexsort((node, cell))
    node, cell = node[order], cell[order]
    head = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
    lead = node[np.flatnonzero(head)][np.cumsum(head) - 1]
    ties = np.unique(np.stack([node, lead], 1)[node != lead], axis=0)
    node, cell = node[head], cell[head]
    order = np.argsort(node, kind="stable")
    node, cell = node[order], cell[order]
    cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    t, n = len(ties), len(cuts)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(t, np.int64), cuts, len(cell)], pa.int32()), pa.array(cell.view(np.int64)))
    none = pa.nulls(t + n, pa.int64())
    columns = [none, pa.array(np.r_[ties[:, 0], node[cuts]].astype(np.int64)), none, pa.concat_arrays([pa.array(ties[:, 1].astype(np.int64)), pa.nulls(n, pa.int64())]), lists]
    return pa.RecordBatch.from_arrays(columns, schema=_SKETCH)


def sketches(texts: DataFrame, width: int, keys: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows of SKETCH: (doc_id, node, size) for each text; (node, tie) for two nodes with a cell in common; (node, cells) for what `keys` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, found, held = [], [], 0
        known: set[int] = set()
        for batch in text_slices(batches):
            sets = [shingles(t, width) for t in blobs(batch.column("text"))]
            named = [node_of(s) for s in sets]
            for node, own in zip(named, sets, strict=True):
                if node not in known and len(key := keys(own)):
                    known.add(node)
                    nodes.append(np.full(len(key), node))
                    found.append(key)
                    held += len(key)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, pa.int64()), pa.array(map(len, sets), pa.int64()), none, pa.nulls(len(sets), _SKETCH.field("cells").type)], schema=_SKETCH)
            if held > CELLS:
                yield _met(np.concatenate(nodes), np.concatenate(found))
                nodes, found, held, known = [], [], 0, set()
        if held:
            yield _met(np.concatenate(nodes), np.concatenate(found))

    return texts.mapInArrow(run, SKETCH)


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [shingles(t, width) for t in blobs(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "own"])

    return run


def sets_of(texts: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """(node, own): the sets of texts whose doc_id is one of `held`; other nodes may come with them."""
    wanted = held.select(F.col("doc_id").alias("_id")).distinct().hint("merge")  # grows with the texts: never broadcast
    chosen = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]), "left_semi").select("text")
    return chosen.mapInArrow(_sets(width), "node long, own binary")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, slice_sets: int = SLICE_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id): size of each document's set and the smallest doc_id reachable over links."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = cut(sketches(texts, width, lambda own: cells(own, percent)))
    rows = marked.filter("size is not null").select("doc_id", "node", "size")
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("size").alias("size")))
    cluster = cut(clusters(stars(marked)))
    holder = cut(cluster.join(nodes, "node").select("node", "cluster", F.col("first").alias("doc_id")))
    own = sets_of(texts, holder, width)
    members = cut(holder.join(own, "node").dropDuplicates(["node"]).select("node", "cluster", "own"))
    found = linked(members, percent, slice_sets)
    rooted = nodes.withColumn("root", F.col("node")) if found is None else nodes.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("component", "node"))
    low = rooted.groupBy("root").agg(F.min("first").alias("low"))
    named = rooted.join(low, "root").select("node", "low")
    own_id = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("low"))
    return rows.join(named, "node").select("doc_id", F.col("size").alias("n_shingles"), own_id.alias("component_id"))


#: The same in DuckDB: all pairs that share a shingle are counted, groups closed by walking over links.
SQL = r"""
WITH RECURSIVE word AS MATERIALIZED (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
grams AS MATERIALIZED (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM word),
node AS MATERIALIZED (SELECT g, min(doc_id) AS a, len(g) AS n FROM grams WHERE len(g) > 0 GROUP BY g),
gram AS MATERIALIZED (SELECT a, n, unnest(list_transform(g, lambda x: hash(x))) AS h FROM node),
link AS MATERIALIZED (
    SELECT x.a AS a, y.a AS b FROM gram x JOIN gram y ON x.h = y.h AND x.a <> y.a AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
    GROUP BY x.a, y.a, x.n, y.n HAVING 190 * count(*) >= 90 * (x.n + y.n)),
walk AS (SELECT a, a AS b FROM node UNION SELECT walk.a, link.b FROM walk JOIN link ON walk.b = link.a),
low AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a)
SELECT grams.doc_id, CAST(len(grams.g) AS BIGINT) AS n_shingles, coalesce(low.component_id, grams.doc_id) AS component_id
FROM grams LEFT JOIN node ON grams.g = node.g LEFT JOIN low ON node.a = low.a
"""
