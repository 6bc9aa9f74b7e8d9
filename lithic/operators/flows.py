"""Business flows: what is reachable from route files or from files named after a business word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.text import base_name, title_case
from lithic.operators import traverse as G
from lithic.operators.relations import first_per_key, table_users
from lithic.session import cut

# Business words that can seed a flow.
FLOW_WORDS = """auth login logout register signup signin password session oauth token user account profile order checkout cart
payment invoice billing subscription notification email message chat upload download file search report export import schedule
booking reservation inventory product catalog review comment like follow admin permission role payroll attendance leave
onboarding employee webhook sync job queue""".split()
MIN_ROUTE_FLOWS, MAX_KEYWORD_FLOWS, KEYWORD_ENTRIES, FLOW_LIMIT, STEP_FILES = 8, 24, 40, 30, 8


def route_flow_seeds(routes: DataFrame) -> DataFrame:
    """(flow, name, kind, entry, n_routes): one flow per route file, files that share a name count once."""
    order = ["ord"] if "ord" in routes.columns else ["line", "method", "path"]
    first = first_per_key(routes.select("file", "path", *order), ["file"], order)
    counts = routes.groupBy("file").agg(F.count("*").alias("n_routes"))
    segs = F.slice(F.filter(F.split("path", "/"), lambda s: (s != "") & ~s.startswith(":") & ~s.startswith("[") & (s != "api")), 1, 2)
    raw = F.when(F.size(segs) > 0, F.array_join(segs, " ")).otherwise(F.regexp_replace(base_name(F.col("file")), r"\.(ts|js|py|go|rb|java|php|rs|cs)$", ""))
    named = first.join(counts, "file").withColumn("name", title_case(F.regexp_replace(raw, "[-_]", " ")))
    return first_per_key(named.select("name", "file", "n_routes", *order), ["name"], [*order, "file"]).select(
        F.concat(F.lit("route:"), "name").alias("flow"), "name", F.lit("api").alias("kind"), F.col("file").alias("entry"), "n_routes"
    )


def keyword_flow_seeds(files: DataFrame) -> DataFrame:
    """(flow, name, kind, entry, file): files whose path holds a business word as a whole part."""
    words = F.array(*[F.lit(w) for w in FLOW_WORDS])
    p = F.lower("path")
    has = F.filter(words, lambda w: F.rlike(p, F.concat(F.lit("(^|[/_.-])"), w, F.lit("s?([/_.-]|$)"))))
    hits = files.filter(F.col("functions") > 0).select("path", F.explode(has).alias("word"))
    entry = hits.groupBy("word").agg(F.min("path").alias("entry"))
    return hits.join(entry, "word").select(
        F.concat(F.lit("kw:"), "word").alias("flow"), title_case(F.col("word")).alias("name"), F.lit("domain").alias("kind"), "entry", F.col("path").alias("file")
    )


def _first_functions(seeds: DataFrame, n: int) -> DataFrame:
    """At most n entry functions per flow; the row-number filter prunes before the shuffle."""
    w = Window.partitionBy("seed").orderBy("node")
    return seeds.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def infer_flows(files, functions, call_edges, routes, db, limit: int = FLOW_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Flows (flow, name, kind, entry, n_routes, function_count, tables_written) and steps (flow, i, label, ref)."""
    fn = functions.select(F.col("id").alias("node"), "file")
    seeds = cut(route_flow_seeds(routes))
    starts = seeds.join(fn, seeds.entry == fn.file).select(F.col("flow").alias("seed"), "node")
    meta = seeds
    if seeds.limit(MIN_ROUTE_FLOWS).count() < MIN_ROUTE_FLOWS:
        kw = keyword_flow_seeds(files)
        kw_meta = kw.select("flow", "name", "kind", "entry").distinct().withColumn("n_routes", F.lit(0).cast("bigint"))
        meta = seeds.unionByName(kw_meta.orderBy("flow").limit(MAX_KEYWORD_FLOWS))
        kw_starts = kw.join(fn, "file").select(F.col("flow").alias("seed"), "node")
        starts = starts.unionByName(_first_functions(kw_starts, KEYWORD_ENTRIES))
    chain = G.reach(call_edges, starts).withColumnRenamed("seed", "flow")
    sizes = chain.groupBy("flow").agg(F.count("*").alias("function_count"))
    per_file = chain.join(fn, "node").groupBy("flow", "file").agg(F.min("depth").alias("depth"))
    touched = per_file.select("flow", "file").union(meta.select("flow", F.col("entry").alias("file"))).distinct()
    written = (
        touched.join(table_users(db).filter("is_write").select("file", "table"), "file")
        .select("flow", "table").distinct().groupBy("flow").agg(F.count("*").alias("tables_written"))
    )
    flows = (
        meta.join(sizes, "flow", "left").join(written, "flow", "left").fillna(0, ["function_count", "tables_written"])
        .orderBy(F.desc("function_count"), "flow").limit(limit)
    )
    w = Window.partitionBy("flow").orderBy("depth", "file")
    walked = per_file.join(meta.select("flow", F.col("entry").alias("file")), ["flow", "file"], "left_anti").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= STEP_FILES)
    steps = meta.select("flow", F.lit(0).alias("i"), F.col("entry").alias("ref")).unionByName(walked.select("flow", "i", F.col("file").alias("ref")))
    return flows, steps.select("flow", "i", base_name(F.col("ref")).alias("label"), "ref")
