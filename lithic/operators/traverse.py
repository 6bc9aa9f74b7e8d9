"""Graph algorithms as fixpoint loops of joins and aggregates.

Every loop works on semi-naive frontiers and cuts its lineage with reliable checkpoints, so a lost
executor costs one iteration and not the whole history. Edges are (src, dst) of any one type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.session import cut, cut_counted, cut_observed


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without self loops."""
    return edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").filter(F.col("src") != F.col("dst"))
    return e.unionByName(reverse(e)).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, indeg, outdeg) over distinct edges, self loops dropped."""
    e = clean_edges(edges)
    ends = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(
        e.select("dst", F.lit(1), F.lit(0))
    )
    return ends.groupBy("id").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): everything reachable from each seed, with its smallest depth.

    `seeds` is (seed, node). A node is expanded once per seed, when it first appears. Where no node has more than one
    successor and no depth ends the search, rounds grow with the logarithm of the depth.
    """
    e = cut(edges.select("src", "dst"))
    if max_depth is None and _single(e):
        return _reach_single(e, seeds)
    frontier, fresh = cut_counted(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)))
    recent, depth = [frontier], 0
    while fresh and (max_depth is None or depth < max_depth):
        depth += 1
        if len(recent) > 6:  # fold the many small levels into one table now and then
            recent = [cut(reduce(DataFrame.unionByName, recent))]
        seen = reduce(DataFrame.unionByName, recent).select("seed", "node")
        step = (
            frontier.join(e, frontier.node == e.src)
            .select("seed", F.col("dst").alias("node"))
            .distinct()
            .join(seen, ["seed", "node"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier, fresh = cut_counted(step)
        recent.append(frontier)
    return reduce(DataFrame.unionByName, recent)


def _jump(far: DataFrame, **merge: Column) -> DataFrame:
    """Pointers (id, to, ...) of twice the length; `merge` joins a value of the first half with `<name>_on` of the second."""
    on = far.select(F.col("id").alias("to"), F.col("to").alias("next"), *[F.col(k).alias(f"{k}_on") for k in merge])
    return far.join(on, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"), *[v.alias(k) for k, v in merge.items()])


def _single(e: DataFrame) -> bool:
    """Whether no node has more than one edge that leaves it."""
    return e.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _reach_single(e: DataFrame, seeds: DataFrame) -> DataFrame:
    """`reach` by pointers of doubled length: what is known up to a depth, moved on by that depth, is known up to twice the depth."""
    known, n = cut_counted(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)))
    far, length = e.select(F.col("src").alias("id"), F.col("dst").alias("to")), 1
    while True:
        moved = known.join(far, known.node == far.id).select("seed", F.col("to").alias("node"), (F.col("depth") + length).alias("depth"))
        known, now = cut_counted(known.unionByName(moved).groupBy("seed", "node").agg(F.min("depth").alias("depth")))
        if now == n:
            return known
        far, length, n = cut(_jump(far).select("id", "to")), 2 * length, now


def _steps(e: DataFrame) -> DataFrame:
    """(id, to) of distinct edges, one for every node; an end points at itself, as a cycle of one."""
    ends = e.select(F.col("dst").alias("id")).distinct().join(e.select(F.col("src").alias("id")), "id", "left_anti")
    return cut(e.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionByName(ends.withColumn("to", F.col("id"))))


def _rings(step: DataFrame) -> DataFrame:
    """(id, low): the members of cycles of `_steps`, each with the smallest member of its cycle."""
    # Only what pointers still reach is followed on; once they reach all that is left, it is the members of cycles.
    far, size = step, step.count()
    while True:
        ring, n = cut_counted(far.select(F.col("to").alias("id")).distinct())
        if n == size:
            break
        far, size = cut(_jump(far.join(ring, "id", "left_semi")).select("id", "to")), n
    # The least node ahead; once a round changes none, it is the least of the whole cycle.
    low = step.join(ring, "id", "left_semi").withColumn("low", F.least("id", "to"))
    lower = 1
    while lower:
        before = low.select("id", F.col("low").alias("was"))
        low, seen = cut_observed(
            _jump(low, low=F.least("low", "low_on")).join(before, "id").select("id", "to", "low", (F.col("low") < F.col("was")).alias("fell")),
            fell=F.count_if("fell"),
        )
        low, lower = low.drop("fell"), seen["fell"]
    return low.select("id", "low")


def reach_counts(edges: DataFrame) -> DataFrame:
    """(seed, reached): how many nodes each node with successors reaches, itself included.

    Where no node has more than one successor, a closure is a path into a cycle or to an end, so its size follows from
    pointers of doubled length without listing its members. Other graphs list the pairs.
    """
    e = cut(edges.select("src", "dst").distinct())
    if not _single(e):
        return reach(e, e.select(F.col("src").alias("seed"), F.col("src").alias("node"))).groupBy("seed").agg(F.count("*").alias("reached"))
    step = _steps(e)
    low = _rings(step)
    cycles = low.join(low.groupBy("low").agg(F.count("*").alias("members")), "low").select(F.col("id").alias("to"), "members")
    # Steps to the cycle: its members point at themselves.
    inside = low.select("id", F.lit(True).alias("inside"))
    path = cut(
        step.join(inside, "id", "left").select("id", F.when(F.col("inside"), F.col("id")).otherwise(F.col("to")).alias("to"), F.when(F.col("inside"), 0).otherwise(1).cast("bigint").alias("steps"))
    )
    moved = 1
    while moved:
        path, seen = cut_observed(_jump(path, steps=F.col("steps") + F.col("steps_on")), moved=F.count_if("moved"))
        path, moved = path.drop("moved"), seen["moved"]
    return (
        path.join(e.select(F.col("src").alias("id")), "id", "left_semi").join(cycles, "to")
        .select(F.col("id").alias("seed"), (F.col("steps") + F.col("members")).alias("reached"))
    )


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): weakly connected components by alternating large-star and small-star.

    Each round shrinks the distance to the smallest member, so the rounds grow with the logarithm of
    the diameter and not with the diameter itself. A round that changes nothing ends the loop: two checksums
    of the edges are observed while they are written, so no round is read again to compare it.
    """
    mark = F.xxhash64("src", "dst")
    sums = {"every": F.bit_xor(mark), "odd": F.bit_xor(F.when(F.xxhash64("dst", "src") % 2 == 0, mark))}
    e, state = cut_observed(undirected(edges).filter(F.col("src") > F.col("dst")), **sums)
    while state["n"]:
        both = e.unionByName(reverse(e))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = (
            both.join(low, "src").filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        ).filter(F.col("src") != F.col("dst")).distinct()
        small_low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = (
            large.join(small_low, "src")
            .select(F.explode(F.array(F.struct(F.col("dst").alias("v"), "low"), F.struct(F.col("src").alias("v"), "low"))).alias("p"))
            .select(F.col("p.v").alias("src"), F.col("p.low").alias("dst"))
            .filter(F.col("src") != F.col("dst"))
            .distinct()
        )
        before = state
        e, state = cut_observed(small, **sums)
        if state == before:
            break
    found = e.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    everyone = nodes.select("id") if nodes is not None else nodes_of(edges)
    return everyone.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _trim(e: DataFrame) -> tuple[DataFrame, int]:
    """Drop edges at nodes without predecessors or successors until none is left; count the rest."""
    size = -1
    while True:
        kept, n = cut_counted(
            e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
                e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"
            ).select("src", "dst")
        )
        if n == size:
            return kept, n
        e, size = kept, n


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) for members of cycles; the component is named by its smallest member.

    Trim, then colour: every node takes the smallest label that reaches it, the owner of a colour walks
    back inside its colour, and the nodes met form its component. Repeats on what remains. Where no node has more
    than one successor, the components are the cycles, found by pointers of doubled length.
    """
    e = cut(clean_edges(edges))
    if _single(e):
        low = _rings(_steps(e))
        sizes = low.groupBy("low").agg(F.count("*").alias("n")).filter("n > 1")
        return low.join(sizes, "low", "left_semi").select("id", F.col("low").alias("component"))
    e, n_edges = _trim(e)
    done: list[DataFrame] = []
    while n_edges:
        colour = cut(nodes_of(e).withColumn("c", F.col("id")))
        moving = True
        while moving:
            pushed = e.join(colour, e.src == colour.id).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("p"))
            new = cut(colour.join(pushed, "id", "left").select("id", F.least("c", "p").alias("c"), (F.col("p") < F.col("c")).alias("moved")))
            moving = not new.filter("moved").isEmpty()
            colour = new.select("id", "c")
        inside = (
            e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src")
            .join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
            .filter("cs = cd")
            .select("src", "dst")
        )
        inside = cut(inside)
        roots = colour.filter("id = c").select(F.col("c").alias("seed"), F.col("id").alias("node"))
        members = reach(reverse(inside), roots).select(F.col("node").alias("id"), F.col("seed").alias("component"))
        members = cut(members)
        done.append(members)
        ids = members.select("id")
        e, n_edges = _trim(
            cut(
                e.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
                .join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
                .select("src", "dst")
            )
        )
    if not done:
        return nodes_of(edges).limit(0).select("id", F.col("id").alias("component"))
    found = reduce(DataFrame.unionByName, done)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return found.join(sizes, "component", "left_semi").select("id", "component")


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank) over distinct edges; the mass of nodes without successors is spread evenly.

    The loose mass of a round is summed while the round's table is written, so every round reads the
    previous one exactly once.
    """
    e = cut(clean_edges(edges))
    nodes, n = cut_counted(
        nodes_of(e).join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out")), "id", "left").fillna(0, ["out"])
    )
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    rank = nodes.select("id", "out", F.lit(1.0 / n).alias("rank"))
    loose = nodes.filter("out = 0").count() / n
    for _ in range(iterations):
        share = rank.filter("out > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("s"))
        got = e.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("s").alias("got"))
        new = nodes.join(got, "id", "left").select(
            "id", "out", (F.lit((1 - damping + damping * loose) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")
        )
        rank, seen = cut_observed(new, loose=F.sum(F.when(F.col("out") == 0, F.col("rank"))))
        loose = seen["loose"] or 0.0
    return rank.select("id", "rank")


def communities(edges: DataFrame, rounds: int = 12, every: int = 3) -> DataFrame:
    """(id, community): synchronous label propagation, most frequent neighbour label, ties to the smallest."""
    e = cut(undirected(edges))
    label = nodes_of(e).withColumn("community", F.col("id"))
    for i in range(1, rounds + 1):
        votes = (
            e.join(label.withColumnRenamed("id", "src"), "src")
            .groupBy(F.col("dst").alias("id"), "community")
            .agg(F.count("*").alias("n"))
        )
        label = votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community"))
        if i % every == 0:
            new = cut(label)
            if i > every and new.join(last, ["id", "community"], "left_anti").isEmpty():  # noqa: F821
                return new
            label = last = new
    return label


def _layers_single(e: DataFrame) -> DataFrame:
    """`layers` by pointers of doubled length: the longest paths of up to that length end where a pointer meets the longest ones so far."""
    low = cut(_rings(_steps(e)))
    ring = cut(low.join(low.groupBy("low").agg(F.count("*").alias("n")).filter("n > 1"), "low", "left_semi").select("id"))
    layer = nodes_of(e).join(ring, "id", "left_anti").withColumn("layer", F.lit(0))
    free = e.join(ring.withColumnRenamed("id", "src"), "src", "left_anti").join(ring.withColumnRenamed("id", "dst"), "dst", "left_anti")
    (far, n), length = cut_counted(free.select(F.col("src").alias("id"), F.col("dst").alias("to"))), 1
    while n:
        longer = layer.join(far, "id").select(F.col("to").alias("id"), (F.col("layer") + length).alias("layer"))
        layer = cut(layer.unionByName(longer).groupBy("id").agg(F.max("layer").alias("layer")))
        (far, n), length = cut_counted(_jump(far).select("id", "to")), 2 * length
    return layer


def layers(edges: DataFrame) -> DataFrame:
    """(id, layer): longest distance from a source, by peeling nodes whose predecessors are all placed.

    Nodes on or behind a cycle are never peeled and do not appear. Where no node has more than one successor, rounds grow
    with the logarithm of the distance.
    """
    e = cut(clean_edges(edges))
    if _single(e):
        return _layers_single(e)
    indeg = nodes_of(e).join(e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need")), "id", "left").fillna(0, ["need"])
    front, fresh = cut_counted(indeg.filter("need = 0").select("id", F.lit(0).alias("layer")))
    open_ = cut(indeg.filter("need > 0"))
    placed, k = [front], 0
    while fresh:
        k += 1
        hit = front.join(e, front.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("h"))
        left = cut(open_.join(hit, "id", "left").select("id", (F.col("need") - F.coalesce("h", F.lit(0))).alias("need")))
        front, fresh = cut_counted(left.filter("need = 0").select("id", F.lit(k).alias("layer")))
        open_ = left.filter("need > 0")
        placed.append(front)
    return reduce(DataFrame.unionByName, placed)


def is_dag(edges: DataFrame) -> bool:
    e = clean_edges(edges)
    return layers(e).count() == nodes_of(e).count()


def bfs_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) from a set of roots taken together."""
    r = reach(edges, roots.select(F.lit(0).alias("seed"), F.col("id").alias("node")))
    return r.select(F.col("node").alias("id"), "depth")


def centre_depth(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, depth): distance, either way along edges, from the one centre of each component.

    Where no node has more than one successor, a component is a cycle, or an end, with trees that lead to it. A node then
    follows its path until it meets the path ahead of the centre; on the cycle the shorter way round counts. All of that
    takes pointers of doubled length. Other graphs take a round a step.
    """
    e = cut(clean_edges(edges))
    if not _single(e):
        return bfs_depth(undirected(e), centres)
    step = _steps(e)
    low = cut(_rings(step))
    ahead = cut(_reach_single(e, centres.select(F.lit(0).alias("seed"), F.col("id").alias("node"))).select(F.col("node").alias("id"), "depth"))
    on = ahead.join(low, "id")
    cycle = on.groupBy("low").agg(F.min("depth").alias("entry"), F.count("*").alias("members"))
    after = F.col("depth") - F.col("entry")
    met = ahead.join(on.join(cycle, "low").select("id", (F.col("entry") + F.least(after, F.col("members") - after)).alias("round")), "id", "left")
    met = cut(met.select(F.col("id").alias("to"), F.coalesce("round", "depth").cast("int").alias("depth")))
    stop = ahead.select("id").union(low.select("id")).distinct().withColumn("stop", F.lit(True))
    path = cut(step.join(stop, "id", "left").select("id", F.when(F.col("stop"), F.col("id")).otherwise(F.col("to")).alias("to"), F.when(F.col("stop"), 0).otherwise(1).alias("steps")))
    moved = 1
    while moved:
        path, seen = cut_observed(_jump(path, steps=F.col("steps") + F.col("steps_on")), moved=F.count_if("moved"))
        path, moved = path.drop("moved"), seen["moved"]
    alone = centres.select("id").distinct().join(path.select("id"), "id", "left_anti").withColumn("depth", F.lit(0))
    return path.join(met, "to").select("id", (F.col("steps") + F.col("depth")).alias("depth")).unionByName(alone)


def classify_component(n: Column, m: Column, max_degree: Column, dag: Column) -> Column:
    """Shape of a component from its size, edges, largest degree and acyclicity."""
    return (
        F.when(n <= 1, "point")
        .when((n <= 4) & (m <= n), "circle")
        .when(m == n - 1, "tree")
        .when((max_degree >= n * 0.55) & (n >= 5), "radial")
        .when(dag & (m <= n * 3), "hierarchical")
        .otherwise("force")
    )


def ancestors(tree: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, ancestor, depth) of a parent table (id, parent), the node itself at depth 0."""
    up = tree.filter(F.col("parent").isNotNull()).select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    seeds = tree.select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return reach(up, seeds, max_depth).select(F.col("seed").alias("id"), F.col("node").alias("ancestor"), "depth")


def lift_edges(edges: DataFrame, closure: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges (src, dst, verb, n) moved to the nearest visible ancestors, merged, with the commonest verb."""
    near = closure.join(visible.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").groupBy("id").agg(
        F.min_by("ancestor", "depth").alias("near")
    )
    moved = (
        edges.join(near.select(F.col("id").alias("src"), F.col("near").alias("a")), "src")
        .join(near.select(F.col("id").alias("dst"), F.col("near").alias("b")), "dst")
        .filter("a <> b")
    )
    votes = moved.groupBy("a", "b", "verb").agg(F.sum("n").alias("n"))
    return votes.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(
        F.sum("n").alias("weight"), F.min_by("verb", F.struct(-F.col("n"), F.col("verb"))).alias("verb")
    )


def container_heat(closure: DataFrame, heat: DataFrame) -> DataFrame:
    """(id, heat): the hottest descendant of every container."""
    return closure.join(heat, "id").filter("depth > 0").groupBy(F.col("ancestor").alias("id")).agg(F.max("heat").alias("heat"))


def visible_frontier(tree: DataFrame, expanded: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids shown when some containers are expanded: below expanded nodes only, and not themselves expanded."""
    kids = tree.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    open_kids = kids.join(expanded.withColumnRenamed("id", "src"), "src", "left_semi")
    shown = reach(open_kids, roots.select(F.lit(0).alias("seed"), F.col("id").alias("node")))
    opened = open_kids.select(F.col("src").alias("id")).distinct()
    return shown.select(F.col("node").alias("id")).join(opened, "id", "left_anti")


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The given ids and everything one edge away, strictly one hop."""
    e = undirected(edges)
    return ids.select("id").union(e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("dst")).distinct()
