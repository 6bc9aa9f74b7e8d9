"""Interactive list, detail and aggregate queries over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions import rules
from lithic.functions.text import base_name, dir_name, lc
from lithic.operators import traverse as G
from lithic.operators.quality import layered
from lithic.operators.relations import table_users

# List lengths.
FILE_ROWS, FUNCTION_ROWS, CLASS_ROWS = 800, 700, 800
GRAPH_FILES, GRAPH_LINKS, TABLE_NODES, TABLE_LINKS, TABLES_PER_FILE = 300, 900, 120, 400, 8
LENS_NODES = 30


def _contains(columns: list[str], term: str) -> Column:
    keep: Column = F.lit(False)
    for c in columns:
        keep = keep | lc(F.col(c)).contains(term.lower().strip())
    return keep if term.strip() else F.lit(True)


def list_filter(df: DataFrame, columns: list[str], term: str = "", equals: dict[str, str] | None = None, order: list | None = None, limit: int | None = None) -> DataFrame:
    """Rows where one of the columns contains the term and the chosen facets match."""
    out = df.filter(_contains(columns, term))
    for c, v in (equals or {}).items():
        out = out.filter(F.col(c) == v)
    if order:
        out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def file_list(files: DataFrame, term: str = "", lang: str | None = None) -> DataFrame:
    return list_filter(files, ["path"], term, {"lang": lang} if lang else None, ["path"], FILE_ROWS)


def function_list(functions: DataFrame, term: str = "") -> DataFrame:
    return list_filter(functions, ["name", "file"], term, None, ["id"], FUNCTION_ROWS)


def route_list(routes: DataFrame, term: str = "", framework: str | None = None) -> DataFrame:
    return list_filter(routes, ["method", "path", "file"], term, {"framework": framework} if framework else None)


def dependency_list(deps: DataFrame, term: str = "", scope: str | None = None) -> DataFrame:
    return list_filter(deps, ["name"], term, {"scope": scope} if scope else None)


def sort_table(df: DataFrame, column: str, descending: bool, tie: list[str], limit: int) -> DataFrame:
    return df.orderBy(F.desc(column) if descending else F.asc(column), *tie).limit(limit)


def file_detail(path: str, files, imports, routes, db, functions) -> DataFrame:
    """(section, item): internal and external imports, importers, routes, tables, functions of one file."""
    section = lambda name, df, item: df.select(F.lit(name).alias("section"), item.alias("item")).distinct()
    mine = imports.filter(F.col("file") == path)
    users = table_users(db.filter(F.col("file") == path))
    parts = [
        section("imports", mine.filter(F.col("resolved").isNotNull()), F.col("resolved")),
        section("imported by", imports.filter(F.col("resolved") == path), F.col("file")),
        section("routes", routes.filter(F.col("file") == path), F.concat_ws(" ", "method", "path")),
        section("writes", users.filter("is_write"), F.col("table")),
        section("reads", users.filter("not is_write"), F.col("table")),
        section("functions", functions.filter(F.col("file") == path), F.concat_ws("#", "name", F.col("line").cast("string"))),
    ]
    if "source" in imports.columns:
        parts.append(section("external", mine.filter(F.col("resolved").isNull() & F.col("source").isNotNull()), F.col("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def function_detail(functions: DataFrame, call_edges: DataFrame) -> DataFrame:
    """(id, complexity, band, calls, callers) for every function; filter one for a single page."""
    calls = call_edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("calls"))
    callers = call_edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    return (
        functions.select("id", "complexity", rules.complexity_band(F.col("complexity")).alias("band"))
        .join(calls, "id", "left")
        .join(callers, "id", "left")
        .fillna(0, ["calls", "callers"])
    )


def class_methods(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """(class_id, function_id): functions whose line falls inside a class of the same file."""
    c = classes.select(F.col("id").alias("class_id"), "file", F.col("line").alias("first"), F.col("end_line").alias("last"))
    return c.join(functions.select(F.col("id").alias("function_id"), "file", "line"), "file").filter(
        F.col("line").between(F.col("first"), F.col("last"))
    ).select("class_id", "function_id")


def layer_matrix(imports: DataFrame) -> DataFrame:
    """(source, target, weight): imports between different layers."""
    e = layered(imports).select(F.col("a").alias("source"), F.col("b").alias("target"))
    return e.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def module_of(path: Column) -> Column:
    """The first two folders of a path, '(root)' for files at the top."""
    d = dir_name(path)
    return F.when(d == "", "(root)").otherwise(F.regexp_extract(d, r"^([^/]+(?:/[^/]+)?)", 1))


def module_matrix(imports: DataFrame) -> DataFrame:
    e = imports.filter(F.col("resolved").isNotNull()).select(
        module_of(F.col("file")).alias("source"), module_of(F.col("resolved")).alias("target")
    )
    return e.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def co_access_pairs(db: DataFrame, per_file: int = TABLES_PER_FILE, limit: int = TABLE_LINKS) -> DataFrame:
    """(a, b): table pairs used in one file. A file offers its first few tables by name, as in the schema view,

    so it yields a bounded number of pairs; the row-number filter prunes before the shuffle.
    """
    w = Window.partitionBy("file").orderBy("table")
    first = (
        db.filter(F.col("table").isNotNull()).select("file", "table").distinct().withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_file)
    )
    tables = first.groupBy("file").agg(F.array_sort(F.collect_list("table")).alias("t"))
    pairs = F.flatten(
        F.transform("t", lambda x, i: F.transform(F.slice(F.col("t"), i + 2, F.size("t")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    return tables.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct().orderBy("a", "b").limit(limit)


def dependency_graph(imports: DataFrame, nodes: int = GRAPH_FILES, links: int = GRAPH_LINKS) -> DataFrame:
    """(source, target): links among the files of highest degree."""
    e = imports.filter(F.col("resolved").isNotNull()).select(F.col("file").alias("src"), F.col("resolved").alias("dst"))
    ends = e.select(F.col("src").alias("id")).union(e.select("dst"))
    top = ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(nodes).select("id")
    kept = (
        G.clean_edges(e)
        .join(F.broadcast(top.withColumnRenamed("id", "src")), "src", "left_semi")  # at most `nodes` rows
        .join(F.broadcast(top.withColumnRenamed("id", "dst")), "dst", "left_semi")
    )
    return kept.select(F.col("src").alias("source"), F.col("dst").alias("target")).orderBy("source", "target").limit(links)


def lens(systems: DataFrame, name: str) -> DataFrame:
    """Systems seen through one lens; `systems` has id, kind, routes and tables counts."""
    keep = {
        "business": F.col("kind") == "business",
        "technical": F.col("kind").isin("technical", "cross-cutting"),
        "api": F.col("routes") > 0,
        "database": F.col("tables") > 0,
        "infra": F.col("kind").isin("infrastructure", "integration"),
        "security": F.col("id").rlike("auth|security|permission"),
    }
    return systems.filter(keep.get(name, F.lit(True)))


def lens_graph(systems: DataFrame, edges: DataFrame, name: str, limit: int = LENS_NODES) -> DataFrame:
    """Ids of the lens; three of the lenses also show their direct neighbours, strictly one hop."""
    ids = lens(systems, name).select("id")
    if name in ("api", "database", "security"):
        ids = G.neighbours(edges, ids)
    return systems.join(ids, "id", "left_semi").orderBy(F.desc("files"), "id").limit(limit)


def ring_positions(systems: DataFrame, limit: int = 26) -> DataFrame:
    """Two-ring placement of the system map: business inside, the rest outside."""
    shown = systems.orderBy(F.desc("confidence"), "id").limit(limit)
    inner = F.col("kind") == "business"
    ring = Window.partitionBy("ring")
    placed = shown.select("id", F.when(inner, 0).otherwise(1).alias("ring"), "confidence")
    angle = 2 * F.pi() * (F.row_number().over(ring.orderBy(F.desc("confidence"), "id")) - 1) / F.count("*").over(ring)
    radius = F.when(F.col("ring") == 0, 150.0).otherwise(290.0)
    return placed.select("id", "ring", F.round(radius * F.cos(angle), 3).alias("x"), F.round(radius * F.sin(angle), 3).alias("y"))


def stroke_widths(edges: DataFrame) -> DataFrame:
    top = edges.agg(F.greatest(F.max("strength"), F.lit(1))).scalar()
    return edges.withColumn("width", F.lit(1) + F.floor(F.col("strength") * 4.0 / top + 0.5))


def flow_mermaid(steps: DataFrame) -> DataFrame:
    """(flow, text): a flow's steps (flow, i, label) as flowchart text. A flow has at most nine steps."""
    line = F.concat(F.lit("  s"), F.col("i").cast("string"), F.lit("["), "label", F.lit("]"))
    link = F.when(F.col("i") > 0, F.concat(F.lit("\n  s"), (F.col("i") - 1).cast("string"), F.lit(" --> s"), F.col("i").cast("string"))).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("i", F.concat(line, link).alias("t"))))
    return steps.groupBy("flow").agg(F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n")).alias("text"))


def next_links(steps: DataFrame, key: str, order: str) -> DataFrame:
    """(key, prev, next): consecutive steps, by a join on the step number instead of a window."""
    nxt = steps.select(key, (F.col(order) - 1).alias(order), F.col(order).alias("next"))
    return steps.select(key, order).join(nxt, [key, order]).select(key, F.col(order).alias("prev"), "next")


