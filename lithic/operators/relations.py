"""Small relational operators shared by the stages: first-per-key, language stats, table summary, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.languages import DATA_LANGUAGES, LABELS
from lithic.functions.rules import is_write


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in a total order.

    An aggregate with a struct minimum combines on the map side, so a key that holds most of the rows
    costs one row per task and never gathers in one place as a window would.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("r")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def dedupe_routes(routes: DataFrame) -> DataFrame:
    """One route per (method, path, file), the highest-priority pattern first."""
    order = [c for c in ("prio", "ord", "line") if c in routes.columns]
    return first_per_key(routes, ["method", "path", "file"], order)


def dedupe_env(env: DataFrame) -> DataFrame:
    return first_per_key(env, ["name"], ["ord"] if "ord" in env.columns else ["file", "line"])


def dedupe_dependencies(deps: DataFrame) -> DataFrame:
    return first_per_key(deps, ["ecosystem", "name"], ["ord"] if "ord" in deps.columns else ["from"])


def language_stats(files: DataFrame) -> DataFrame:
    """(id, label, files, bytes) without data formats, largest first."""
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return (
        files.filter(F.col("lang").isNotNull() & ~F.col("lang").isin(list(DATA_LANGUAGES)))
        .groupBy(F.col("lang").alias("id"))
        .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
        .select("id", F.coalesce(F.element_at(labels, F.col("id")), F.col("id")).alias("label"), "files", "bytes")
        .orderBy(F.desc("bytes"), "id")
    )


def table_summary(db: DataFrame) -> DataFrame:
    """(name, kinds, read_by, written_by, accesses, defined_in). Schema definition does not count as a write here."""
    hits = db.filter(F.col("table").isNotNull())
    w = is_write(F.col("kind"), F.col("op"), ddl=False)
    per = hits.groupBy(F.col("table").alias("name")).agg(
        F.count("*").alias("accesses"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.max(F.when(F.col("kind") == "ddl-table", F.struct("ord", "file")))["file"].alias("defined_in"),
    )
    return per.join(
        hits.select(F.col("table").alias("name"), "file", w.alias("w"))
        .distinct()
        .groupBy("name")
        .agg(F.count_if(F.col("w")).alias("writers"), F.count_if(~F.col("w")).alias("readers")),
        "name",
    )


def table_users(db: DataFrame, ddl: bool = True) -> DataFrame:
    """Distinct (table, file, is_write)."""
    return (
        db.filter(F.col("table").isNotNull())
        .select("table", "file", is_write(F.col("kind"), F.col("op"), ddl).alias("is_write"))
        .distinct()
    )


def one_row(spark, **counts: Column) -> DataFrame:
    """A one-row frame of scalar subqueries."""
    return spark.range(1).select(*[c.alias(n) for n, c in counts.items()])


def count_of(df: DataFrame) -> Column:
    return df.agg(F.count("*").alias("n")).scalar()


def manifest_counts(files, functions, classes, routes, db, env, deps, security, flows) -> DataFrame:
    """The one-row count summary of an index."""
    return one_row(
        files.sparkSession,
        files=count_of(files),
        functions=count_of(functions),
        classes=count_of(classes),
        routes=count_of(routes.select("method", "path", "file").distinct()),
        tables=count_of(db.filter(F.col("table").isNotNull()).select("table").distinct()),
        env_vars=count_of(env.select("name").distinct()),
        dependencies=count_of(deps.select("name").distinct()),
        security_findings=count_of(security),
        languages=count_of(language_stats(files)),
        flows=count_of(flows),
        loc=files.agg(F.sum("loc")).scalar(),
    )
