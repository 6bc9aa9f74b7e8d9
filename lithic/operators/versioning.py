"""Snapshots, version comparison, history sampling and churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.operators.relations import count_of, one_row
from lithic.session import cut

TIMELINE_POINTS = 24
COMMIT_LIMIT, CHURN_COMMITS = 4000, 400
# Extensions counted as code in the timeline, and its three path signals.
TIMELINE_EXTS = ".ts .tsx .js .jsx .py .go .rs .java .kt .rb .php .cs .c .cpp .swift .dart .scala".split()
TIMELINE_ROUTES = r"/route\.(ts|js|tsx|jsx)$|routes?\.|controller|_controller|urls\.py|routes\.rb"
TIMELINE_TABLES = r"migration|schema\.|\.sql$|models?\."
TIMELINE_TESTS = r"(^|/)(test|tests|spec|__tests__)(/|$)|\.(test|spec)\."


def snapshot(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, hash): 16 hex characters of SHA-1."""
    return files.select("path", F.substring(F.sha1(content), 1, 16).alias("hash"))


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) with status added, modified, deleted or unchanged: one full outer join."""
    a, b = before.withColumnRenamed("hash", "old"), after.withColumnRenamed("hash", "new")
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(F.col("old") != F.col("new"), "modified")
        .otherwise("unchanged")
    )
    return a.join(b, "path", "full").select("path", status.alias("status"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(
        F.count_if(F.col("status").isin("added", "modified")).alias("changed"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "deleted", "unchanged")],
    )


def compare_entity(entity: str, before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(entity, key, change, detail): added, removed, or changed when a compared value differs."""
    key = F.concat_ws(" ", *keys)
    side = lambda df, mark: df.select(key.alias("key"), F.struct(*[F.col(v).cast("string").alias(v) for v in values] or [F.lit("")]).alias(mark))
    joined = side(before, "a").join(side(after, "b"), "key", "full")
    change = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    )
    detail = F.lit(None).cast("string")
    if values:
        text = lambda m: F.concat_ws(",", *[F.coalesce(F.col(f"{m}.{v}"), F.lit("")) for v in values])
        detail = F.when(change == "changed", F.concat(text("a"), F.lit(" -> "), text("b")))
    return joined.select(F.lit(entity).alias("entity"), "key", change.alias("change"), detail.alias("detail")).filter(
        F.col("change").isNotNull()
    )


def compare_versions(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """Changes of files, functions, routes, tables and dependencies between two versions."""
    specs = [
        ("files", ["path"], ["loc", "functions", "complexity"]),
        ("functions", ["file", "name"], ["complexity", "loc"]),
        ("routes", ["method", "path"], []),
        ("tables", ["name"], []),
        ("dependencies", ["name"], ["version"]),
    ]
    out = None
    for entity, keys, values in specs:
        # One row per key and side: the compared values of the largest row stand for repeated keys.
        pick = lambda df: df.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values]) if values else df.select(*keys).distinct()  # noqa: E731, B023
        part = compare_entity(entity, pick(a[entity]), pick(b[entity]), keys, values)
        out = part if out is None else out.unionByName(part)
    return out


def change_risk(changes: DataFrame) -> DataFrame:
    """One row: weighted count of risky changes and its label."""
    at = lambda e, c: F.count_if((F.col("entity") == e) & (F.col("change") == c))
    risk = (
        at("routes", "added") * 2 + at("routes", "removed") * 3 + at("functions", "removed") + at("tables", "removed") * 4
        + at("dependencies", "changed") + at("files", "removed") * 2
    )
    return changes.agg(risk.alias("risk")).select(
        "risk", F.when(F.col("risk") >= 20, "high").when(F.col("risk") >= 8, "medium").otherwise("low").alias("risk_label")
    )


def version_deltas(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """One row of count differences between two versions."""
    n = lambda d, k: count_of(d[k])
    loc = lambda d: F.coalesce(d["files"].agg(F.sum("loc")).scalar(), F.lit(0))
    return one_row(
        a["files"].sparkSession,
        loc=loc(b) - loc(a), files=n(b, "files") - n(a, "files"),
        functions=n(b, "functions") - n(a, "functions"), routes=n(b, "routes") - n(a, "routes"),
    )


def diff_lanes(changes: DataFrame, files: int = 30) -> DataFrame:
    """Routes, tables and the first files that were added or removed, for the change animation."""
    wanted = changes.filter(F.col("change").isin("added", "removed"))
    first = lambda c: wanted.filter((F.col("entity") == "files") & (F.col("change") == c)).orderBy("key").limit(files)
    return wanted.filter(F.col("entity").isin("routes", "tables")).unionByName(first("added")).unionByName(first("removed")).select(
        "entity", "key", "change"
    )


def newest_commits(commits: DataFrame, limit: int) -> DataFrame:
    """The newest commits by (date, commit): a bounded top-k."""
    return commits.orderBy(F.desc("date"), F.desc("commit")).limit(limit)


def churn(commit_paths: DataFrame, commits: DataFrame | None = None, limit: int = CHURN_COMMITS) -> DataFrame:
    """(path, churn): commits touching each path, over the newest commits when a log is given."""
    rows = commit_paths
    if commits is not None:
        rows = rows.join(newest_commits(commits, limit).select("commit"), "commit", "left_semi")
    return rows.groupBy("path").agg(F.count("*").alias("churn"))


def global_ordinal(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """0-based position in a total order without pulling all rows into one task.

    Rows are range-partitioned on the order, numbered inside their partition, and shifted by the sizes of
    the partitions before, a table with one row per partition.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("__id"), 33)
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__off"))
    low = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.withColumn("__p", part)
        .join(F.broadcast(before), "__p")  # one row per partition
        .withColumn(name, F.col("__off") + low)
        .drop("__id", "__p", "__off")
    )


def sample_evenly(df: DataFrame, order: list[str], points: int = TIMELINE_POINTS) -> DataFrame:
    """Every floor(n / points)-th row of the order plus the last one."""
    numbered = global_ordinal(df, order)
    n = numbered.count()
    step = max(1, n // points)
    return numbered.filter((F.col("i") % step == 0) | (F.col("i") == n - 1))


def timeline_counts(trees: DataFrame, path: str = "path") -> DataFrame:
    """Structural counts per commit of its file list (commit, path)."""
    ext, signals = _signals(F.col(path))
    return trees.groupBy("commit").agg(
        F.count("*").alias("files"),
        *[F.count_if(hit).alias(name) for name, hit in signals.items()],
        F.count_distinct(F.when(signals["code"], ext)).alias("langs"),
    )


def _signals(p: Column) -> tuple[Column, dict[str, Column]]:
    """Extension of a path and the structural signals that the timeline counts."""
    ext = F.regexp_extract(p, r"(\.[^.]*)$", 1)
    return ext, {
        "code": ext.isin(TIMELINE_EXTS), "routes": p.rlike(TIMELINE_ROUTES), "tables": p.rlike(TIMELINE_TABLES), "tests": F.lower(p).rlike(TIMELINE_TESTS)
    }


def validity(changes: DataFrame) -> DataFrame:
    """(path, since, until): when each path was in the tree, from its changes (commit, path, deleted).

    Commits are ordered by their value; `until` is the commit that deleted the path, null while it is there. A path
    that one commit both deletes and writes stays. Deleting what is not there changes nothing.
    """
    per = changes.groupBy("path", "commit").agg(F.min("deleted").alias("deleted"))
    w = Window.partitionBy("path").orderBy("commit")
    flips = per.withColumn("was", F.coalesce(F.lag("deleted").over(w), F.lit(True))).filter(F.col("deleted") != F.col("was"))
    return flips.withColumn("until", F.lead("commit").over(w)).filter(~F.col("deleted")).select("path", F.col("commit").alias("since"), "until")


def timeline_of(intervals: DataFrame, samples: DataFrame) -> DataFrame:
    """The counts of `timeline_counts` at sampled commits, from validity intervals (path, since, until).

    No listing is built. Each end of an interval adds or takes away one file at the first sample that sees it, so
    the sums have a row per sample; running sums over the samples (commit), a bounded number, give the counts.
    """
    points = samples.agg(F.sort_array(F.collect_set("commit"))).scalar()
    ends = intervals.select("path", F.explode(F.array(
        F.struct(F.col("since").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("sign"))
    )).alias("e")).select("path", "e.*").filter("at is not null")
    seen = ends.withColumn("points", points).withColumn("commit", F.array_min(F.filter("points", lambda s: s >= F.col("at")))).filter("commit is not null")
    ext, signals = _signals(F.col("path"))
    langs = [f"__{e}" for e in range(len(TIMELINE_EXTS))]
    tests = {"files": F.lit(True), **signals, **{c: ext == e for c, e in zip(langs, TIMELINE_EXTS, strict=True)}}
    moved = seen.groupBy("commit").agg(*[F.sum(F.when(t, F.col("sign")).otherwise(0)).alias(c) for c, t in tests.items()])
    w = Window.orderBy("commit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = samples.select("commit").distinct().join(moved, "commit", "left").select("commit", *[F.coalesce(F.sum(f"`{c}`").over(w), F.lit(0)).alias(c) for c in tests])
    alive = [F.when(F.col(c) > 0, 1).otherwise(0) for c in langs]
    return run.select("commit", "files", *signals, sum(alive[1:], alive[0]).cast("long").alias("langs"))


def percent_of_max(df: DataFrame, value: str) -> DataFrame:
    """Bars of a chart: each value as a share of the largest."""
    top = F.greatest(df.agg(F.max(value)).scalar(), F.lit(1))
    return df.withColumn("percent", F.floor(F.col(value) * 100.0 / top + 0.5))
