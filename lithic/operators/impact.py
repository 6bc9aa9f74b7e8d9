"""What depends on a file, a function or a table, and how a table or request flows through the code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions import rules
from lithic.functions.text import base_name
from lithic.operators import traverse as G
from lithic.operators.relations import count_of, one_row, table_users


def _seed(spark, value: str) -> DataFrame:
    return spark.createDataFrame([(value, value)], "seed string, node string")


def affected_files(imports: DataFrame, path: str) -> DataFrame:
    """Files that import the path directly or indirectly."""
    e = imports.filter(F.col("resolved").isNotNull()).select(F.col("resolved").alias("src"), F.col("file").alias("dst"))
    r = G.reach(G.clean_edges(e), _seed(imports.sparkSession, path))
    return r.filter("depth > 0").select(F.col("node").alias("path"), "depth")


def impact_of_file(imports, functions, call_edges, routes, db, path: str) -> DataFrame:
    """One row: sizes of everything a removal would touch, and the severity."""
    files = affected_files(imports, path)
    own = functions.filter(F.col("file") == path).select(F.col("id").alias("dst"))
    callers = (
        call_edges.join(own, "dst", "left_semi")
        .select(F.col("src").alias("id"))
        .distinct()
        .join(functions.filter(F.col("file") != path).select("id"), "id", "left_semi")
    )
    out = one_row(
        imports.sparkSession,
        files=count_of(files),
        direct=count_of(files.filter("depth = 1")),
        functions=count_of(callers),
        routes=count_of(routes.filter(F.col("file") == path).select("method", "path").distinct()),
        tables=count_of(db.filter((F.col("file") == path) & F.col("table").isNotNull()).select("table").distinct()),
        tests=count_of(files.filter(rules.is_test(F.col("path")))),
    )
    severity = (
        F.when((F.col("files") >= 10) | (F.col("routes") >= 3), "high")
        .when((F.col("files") >= 3) | (F.col("functions") >= 5), "medium")
        .otherwise("low")
    )
    return out.select(F.lit(path).alias("target"), "*", severity.alias("severity"))


def affected_functions(call_edges: DataFrame, fn_id: str) -> DataFrame:
    r = G.reach(G.reverse(call_edges), _seed(call_edges.sparkSession, fn_id))
    return r.filter("depth > 0").select(F.col("node").alias("id"), "depth")


def impact_of_function(call_edges: DataFrame, functions: DataFrame, fn_id: str) -> DataFrame:
    hit = functions.select("id", "file").join(affected_functions(call_edges, fn_id), "id")
    n = F.col("functions")
    return hit.agg(F.count("*").alias("functions"), F.countDistinct("file").alias("files")).select(
        F.lit(fn_id).alias("target"), "functions", "files", F.when(n >= 15, "high").when(n >= 4, "medium").otherwise("low").alias("severity")
    )


def impact_of_tables(db: DataFrame) -> DataFrame:
    """(table, readers, writers, severity) for every table; filter one for a single answer."""
    users = table_users(db)
    per = users.groupBy("table").agg(
        F.count_if(~F.col("is_write")).alias("readers"),
        F.count_if(F.col("is_write")).alias("writers"),
        F.count_distinct("file").alias("n"),
    )
    n = F.col("n")
    return per.select("table", "readers", "writers", F.when(n >= 8, "high").when(n >= 3, "medium").otherwise("low").alias("severity"))


def table_lifecycle(db: DataFrame) -> DataFrame:
    """Distinct sites (table, stage, file, line) of every table."""
    return (
        db.filter(F.col("table").isNotNull())
        .select("table", rules.lifecycle_stage(F.col("kind"), F.col("op")).alias("stage"), "file", "line")
        .distinct()
    )


def trace_request(routes, functions, call_edges, db, files, method: str, path: str, file: str | None = None) -> DataFrame:
    """Ordered steps of one request: client, middleware, route, services, database, response."""
    spark = routes.sparkSession
    wanted = routes.filter((F.col("method") == method) & (F.col("path") == path))
    prefer = F.when(F.col("file") == F.lit(file), 0).otherwise(1)
    row = wanted.orderBy(prefer, "file").select("file", "framework").first()
    if row is None:
        return spark.createDataFrame([], "ord int, kind string, label string, detail string")
    # One seed stands for the request, so the handlers are explored together.
    seeds = functions.filter(F.col("file") == row["file"]).select(F.lit("request").alias("seed"), F.col("id").alias("node"))
    chain = G.reach(call_edges, seeds).select(F.col("node").alias("id"), "depth").join(functions.select("id", "file"), "id")
    chain_files = chain.filter(F.col("file") != row["file"]).groupBy("file").agg(F.min("depth").alias("depth"))
    used = table_users(db, ddl=False).join(
        chain_files.select("file").union(spark.createDataFrame([(row["file"],)], "file string")), "file", "left_semi"
    )
    tables = used.select(F.concat(F.when(F.col("is_write"), "write ").otherwise("read "), F.col("table")).alias("t")).distinct().orderBy("t").limit(8)
    middleware = files.filter(F.lower("path").contains("middleware")).orderBy("path").limit(4)
    text = lambda df, c, sep=", ": df.agg(F.array_join(F.array_sort(F.collect_list(c)), sep)).scalar()
    fixed = one_row(spark, mw=text(middleware, base_name(F.col("path"))), db=text(tables, "t"))
    step = lambda o, k, l, d: F.struct(F.lit(o).alias("ord"), F.lit(k).alias("kind"), F.lit(l).alias("label"), d.alias("detail"))
    frame = fixed.select(
        F.explode(
            F.array(
                step(0, "client", "Client / Browser", F.lit(f"{method} {path}")),
                step(1, "middleware", "Middleware", F.col("mw")),
                step(2, "route", "Route handler", F.lit(f"{row['file'].split('/')[-1]} ({row['framework']})")),
                step(1000, "db", "Database", F.col("db")),
                step(1001, "response", "Response", F.lit("returned to client")),
            )
        ).alias("s")
    ).select("s.*").filter(F.col("detail").isNotNull() & (F.col("detail") != ""))
    services = chain_files.orderBy("depth", "file").limit(8).select(
        (F.lit(10) + F.col("depth")).alias("ord"), F.lit("service").alias("kind"), base_name(F.col("file")).alias("label"), F.col("file").alias("detail")
    )
    return frame.unionByName(services)
