"""Graph drawing as table operations: every component gets a strategy, a local layout and a place.

Positions follow from ranks inside groups. Ranks come from one range-partitioned sort of all nodes, so
a component of any size spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.operators import traverse as G
from lithic.operators.versioning import global_ordinal
from lithic.session import cut, spread

GAP, LAYER_GAP, PACK_GAP = 60.0, 90.0, 60.0
# Sizes up to which the metrics of a whole drawing are computed in full.
MAX_SEGMENTS, MAX_NODES = 1200, 2000
#: Edges of a block; crossings are counted by pairs of blocks, so that a large component is many small tasks.
BLOCK_EDGES = 400


def rank_in_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add (i, n): position inside a group and the group's size, without a window per group."""
    numbered = global_ordinal(df, [*group, *order], "__i")
    first = numbered.groupBy(*group).agg(F.min("__i").alias("__first"), F.count("*").alias("n"))
    return numbered.join(first, group).withColumn("i", F.col("__i") - F.col("__first")).drop("__i", "__first")


def prepare(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, r, component, degree, layer): what the strategies need to know about a node."""
    comp = cut(G.components(edges, nodes))
    deg = G.undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    peeled = G.layers(edges)
    hub = F.max_by("id", F.struct("degree", F.col("id")))
    base = nodes.select("id", "r").join(comp, "id").join(deg, "id", "left").fillna(0, ["degree"])
    roots = base.groupBy("component").agg(hub.alias("id")).select("id")
    depth = G.centre_depth(edges, roots)
    return cut(
        base.join(peeled, "id", "left").join(depth, "id", "left")
        .select("id", "r", "component", "degree", F.col("layer").alias("peel"), F.coalesce("depth", F.lit(0)).alias("depth"))
    )


def shapes(info: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, n, m, max_degree, dag, shape)."""
    per = info.groupBy("component").agg(
        F.count("*").alias("n"), F.max("degree").alias("max_degree"), (F.count("*") == F.count("peel")).alias("dag")
    )
    m = G.clean_edges(edges).join(info.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(F.count("*").alias("m"))
    j = per.join(m, "component", "left").fillna(0, ["m"])
    return j.withColumn("shape", G.classify_component(F.col("n"), F.col("m"), F.col("max_degree"), F.col("dag")))


def _circle(info: DataFrame) -> DataFrame:
    """Ring ordered by distance from the hub, so that neighbours sit close together."""
    k = rank_in_group(info, ["component"], ["depth", "id"])
    radius = F.greatest(F.lit(GAP), F.col("n") * (F.col("r") * 2 + 12) / (2 * F.pi()))
    a = 2 * F.pi() * F.col("i") / F.col("n")
    return k.select("id", "component", "r", (radius * F.cos(a)).alias("x"), (radius * F.sin(a)).alias("y"))


def _rows(info: DataFrame, level: Column) -> DataFrame:
    """Rows by level, centred; used for trees and layered graphs."""
    k = rank_in_group(info.withColumn("level", level), ["component", "level"], ["depth", "id"])
    return k.select("id", "component", "r", ((F.col("i") - (F.col("n") - 1) / 2) * GAP).alias("x"), (F.col("level") * LAYER_GAP).alias("y"))


def _radial(info: DataFrame) -> DataFrame:
    k = rank_in_group(info, ["component", "depth"], ["id"])
    radius = F.greatest(F.col("depth") * LAYER_GAP, F.when(F.col("depth") > 0, F.col("n") * GAP / (2 * F.pi())).otherwise(0.0))
    a = 2 * F.pi() * F.col("i") / F.col("n")
    return k.select("id", "component", "r", (radius * F.cos(a)).alias("x"), (radius * F.sin(a)).alias("y"))


def _force(info: DataFrame, edges: DataFrame, rounds: int = 12, every: int = 1) -> DataFrame:
    """Springs along edges and repulsion from the mass of the surrounding grid cells of the component.

    A round reads the positions four times, so those of the round before are not computed for each.
    """
    pos = cut(_circle(info))
    e = cut(G.undirected(edges))
    for k in range(1, rounds + 1):
        pull = (
            e.join(pos.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by")), "dst")
            .groupBy(F.col("src").alias("id")).agg(F.avg("bx").alias("px"), F.avg("by").alias("py"))
        )
        cell = lambda c: F.floor(F.col(c) / (GAP * 2))
        grid = pos.groupBy("component", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("mass"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
        offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        near = pos.withColumn("o", F.explode(offs)).withColumn("cx", cell("x") + F.col("o.a")).withColumn("cy", cell("y") + F.col("o.b")).join(grid, ["component", "cx", "cy"])
        dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
        d2 = dx * dx + dy * dy + 25.0
        push = near.groupBy("id").agg(F.sum(dx / d2 * F.col("mass")).alias("rx"), F.sum(dy / d2 * F.col("mass")).alias("ry"))
        step = 0.3 * (1 - k / (rounds + 1))
        move = lambda c, p, r: F.col(c) + step * (F.coalesce(F.col(p) - F.col(c), F.lit(0.0)) * 0.5 + F.coalesce(F.col(r), F.lit(0.0)) * 1500.0)
        pos = pos.join(pull, "id", "left").join(push, "id", "left").select("id", "component", "r", move("x", "px", "rx").alias("x"), move("y", "py", "ry").alias("y"))
        if k % every == 0:
            pos = cut(pos)
    return pos


def crosses(a: str, b: str, c: str, d: str) -> Column:
    """Whether segment a-b properly crosses segment c-d; arguments are prefixes of x and y columns."""
    side = lambda p, q, r: (F.col(q + "x") - F.col(p + "x")) * (F.col(r + "y") - F.col(p + "y")) - (F.col(q + "y") - F.col(p + "y")) * (F.col(r + "x") - F.col(p + "x"))
    return (F.signum(side(c, d, a)) * F.signum(side(c, d, b)) < 0) & (F.signum(side(a, b, c)) * F.signum(side(a, b, d)) < 0)


def _segments(pos: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    at = lambda p, i: pos.select(*[k for k in keys if k != "component"], "component", F.col("id").alias(i), F.col("x").alias(p + "x"), F.col("y").alias(p + "y"))
    return edges.join(at("a", "src"), "src").join(at("b", "dst"), ["dst", *keys])


def quality(pos: DataFrame, edges: DataFrame) -> DataFrame:
    """(strategy, component, crossings, cv, score) of candidate layouts.

    All pairs of edges of a component are looked at, which is quadratic. They are dealt out as pairs of blocks, so a task holds
    two blocks at a time.
    """
    seg = cut(rank_in_group(_segments(pos, G.clean_edges(edges), ["strategy", "component"]), ["strategy", "component"], ["src", "dst"]))
    length = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    cv = seg.groupBy("strategy", "component").agg(F.coalesce(F.try_divide(F.stddev_pop(length), F.avg(length)), F.lit(0.0)).alias("cv"))
    block = lambda at: F.floor(at / BLOCK_EDGES)
    own, last = block(F.col("i")), block(F.col("n") - 1)
    group = ["strategy", "component", "low", "high"]
    kept = seg.select("strategy", "component", own.alias("low"), F.explode(F.sequence(own, last)).alias("high"), "i", "src", "dst", "ax", "ay", "bx", "by")
    later = seg.withColumn("high", own).withColumn("low", F.explode(F.sequence(F.lit(0).cast("bigint"), own)))
    other = later.select(*group, F.col("i").alias("j"), F.col("src").alias("s2"), F.col("dst").alias("d2"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    apart = (F.col("src") != F.col("s2")) & (F.col("src") != F.col("d2")) & (F.col("dst") != F.col("s2")) & (F.col("dst") != F.col("d2"))
    pairs = spread(kept).join(other, group).filter((F.col("i") < F.col("j")) & apart & crosses("a", "b", "c", "d"))
    n = pairs.groupBy("strategy", "component").agg(F.count("*").alias("crossings"))
    return cv.join(n, ["strategy", "component"], "left").fillna(0, ["crossings"]).withColumn("score", F.col("crossings") * 10 + F.col("cv") * 5)


def layout(nodes: DataFrame, edges: DataFrame, aspect: float = 1.4) -> DataFrame:
    """(id, component, strategy, x, y): the best candidate per component, packed and centred."""
    # Every step reads them, so what they come from is computed once.
    nodes, edges = cut(nodes), cut(G.clean_edges(edges))
    info = prepare(nodes, edges)
    kinds = cut(shapes(info, edges))
    n = info.join(kinds.select("component", "n", "dag", "m", "max_degree"), "component")
    pick = lambda df: df.drop("n", "dag", "m", "max_degree")
    tag = lambda df, s: df.withColumn("strategy", F.lit(s))
    cands = [
        tag(_circle(pick(n)), "circle"),
        tag(_rows(pick(n.filter("m = n - 1")), F.col("depth")), "tree"),
        tag(_rows(pick(n.filter("dag")), F.col("peel")), "hierarchical"),
        tag(_radial(pick(n.filter((F.col("max_degree") >= F.col("n") * 0.5) | (F.col("n") <= 24)))), "radial"),
        tag(_force(pick(n.filter("n > 2")), edges), "force"),
    ]
    pos = cands[0]
    for c in cands[1:]:
        pos = pos.unionByName(c)
    pos = cut(pos)
    scored = pos.select("strategy", "component").distinct().join(quality(pos, edges), ["strategy", "component"], "left").fillna(0, ["score"])
    best = scored.groupBy("component").agg(F.min_by("strategy", F.struct("score", "strategy")).alias("strategy"))
    return pack(cut(pos.join(best, ["component", "strategy"])), aspect)


def pack(pos: DataFrame, aspect: float = 1.4) -> DataFrame:
    """Components on a grid, largest first, in rows close to the wanted aspect, centred at the origin."""
    box = pos.groupBy("component").agg(
        F.min(F.col("x") - F.col("r")).alias("x0"), F.min(F.col("y") - F.col("r")).alias("y0"),
        (F.max(F.col("x") + F.col("r")) - F.min(F.col("x") - F.col("r"))).alias("w"), (F.max(F.col("y") + F.col("r")) - F.min(F.col("y") - F.col("r"))).alias("h"),
    )
    ranked = global_ordinal(box.withColumn("size", -(F.col("w") * F.col("h"))), ["size", "component"])
    total = ranked.agg(F.max("w").alias("w"), F.max("h").alias("h"), F.count("*").alias("n")).first()
    if total["n"] == 0:
        return pos
    per_row = max(1, round((total["n"] * aspect * (total["h"] + PACK_GAP) / (total["w"] + PACK_GAP)) ** 0.5))
    placed = ranked.select(
        "component", ((F.col("i") % per_row) * (total["w"] + PACK_GAP) - F.col("x0")).alias("dx"), (F.floor(F.col("i") / per_row) * (total["h"] + PACK_GAP) - F.col("y0")).alias("dy")
    )
    moved = cut(pos.join(placed, "component").withColumn("x", F.col("x") + F.col("dx")).withColumn("y", F.col("y") + F.col("dy")))
    mid = moved.agg(((F.min(F.col("x") - F.col("r")) + F.max(F.col("x") + F.col("r"))) / 2).alias("x"), ((F.min(F.col("y") - F.col("r")) + F.max(F.col("y") + F.col("r"))) / 2).alias("y")).first()
    return moved.select("id", "component", "strategy", "r", (F.col("x") - mid["x"]).alias("x"), (F.col("y") - mid["y"]).alias("y"))


def metrics(pos: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, mean length, length variation, crossings and overlaps; -1 above the size limits."""
    whole = pos.withColumn("component", F.lit(0)).withColumn("strategy", F.lit("all"))
    seg = cut(_segments(whole, edges.select("src", "dst"), ["strategy", "component"]))
    length = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    out = seg.agg(F.count("*").alias("edges"), F.round(F.avg(length), 3).alias("mean_length"), F.round(F.coalesce(F.try_divide(F.stddev_pop(length), F.avg(length)), F.lit(0.0)), 6).alias("length_cv"))
    cross: Column = F.lit(-1)
    if seg.limit(MAX_SEGMENTS + 1).count() <= MAX_SEGMENTS:
        a = seg.withColumn("k", F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")))
        b = a.select("component", F.col("k").alias("k2"), F.col("src").alias("s2"), F.col("dst").alias("d2"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
        apart = (F.col("src") != F.col("s2")) & (F.col("src") != F.col("d2")) & (F.col("dst") != F.col("s2")) & (F.col("dst") != F.col("d2"))
        cross = a.join(b, "component").filter((F.col("k") < F.col("k2")) & apart & crosses("a", "b", "c", "d")).agg(F.count("*")).scalar()
    over: Column = F.lit(-1)
    if pos.limit(MAX_NODES + 1).count() <= MAX_NODES:
        side = pos.agg(F.max("r")).first()[0] * 2
        cell = lambda c: F.floor(F.col(c) / side)
        p = pos.select("id", "x", "y", "r").withColumn("cx", cell("x")).withColumn("cy", cell("y"))
        offs = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        q = p.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("r").alias("r2"), "cx", "cy", F.explode(offs).alias("o")).select(
            "id2", "x2", "y2", "r2", (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy")
        )
        close = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) < F.col("r") + F.col("r2") - 1
        over = p.join(q, ["cx", "cy"]).filter((F.col("id") < F.col("id2")) & close).agg(F.count("*")).scalar()
    return out.withColumn("crossings", cross).withColumn("overlaps", over)
