"""Code quality: metric lists, health, centrality, risk, heat, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions import rules
from lithic.functions.text import base_name, clamp01, js_round
from lithic.operators.relations import count_of, one_row

# Thresholds and list lengths.
LARGE_FILE, LARGE_FUNCTION, COMPLEX_FUNCTION, BIG_UNDOCUMENTED = 400, 60, 12, 15
DUPLICATE_NAME_FILES, DUPLICATE_NAME_LIMIT = 2, 100
DUPLICATE_BLOCK_LOC, DUPLICATE_BLOCK_LIMIT = 8, 60
VIOLATION_LIMIT, TOP_MODULES, INSIGHT_LIMIT = 200, 20, 15


def internal_imports(imports: DataFrame) -> DataFrame:
    return imports.filter(F.col("resolved").isNotNull() & (F.col("resolved") != F.col("file"))).select("file", "resolved")


def fan_distinct(imports: DataFrame) -> DataFrame:
    """(path, fan_in, fan_out) over distinct file pairs."""
    e = internal_imports(imports).distinct()
    ends = e.select(F.col("resolved").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(
        e.select("file", F.lit(0), F.lit(1))
    )
    return ends.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def fan_statements(imports: DataFrame) -> DataFrame:
    """(path, fan_in, fan_out) counting every import statement."""
    e = internal_imports(imports)
    ends = e.select(F.col("resolved").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(
        e.select("file", F.lit(0), F.lit(1))
    )
    return ends.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def _with_fan(files: DataFrame, fan: DataFrame) -> DataFrame:
    return files.join(fan, "path", "left").fillna(0, ["fan_in", "fan_out"])


def dead_files(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Files with symbols that nothing imports and that are no entry point."""
    imported = imports.filter(F.col("resolved").isNotNull()).select(F.col("resolved").alias("path")).distinct()
    has_symbols = F.col("functions") + (F.col("classes") if "classes" in files.columns else F.lit(0)) > 0
    return (
        files.filter(has_symbols & ~rules.is_metric_entrypoint(F.col("path")))
        .select("path")
        .join(imported, "path", "left_anti")
    )


def large_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("loc") >= LARGE_FILE).select("path", "loc").orderBy(F.desc("loc"), "path")


def large_functions(functions: DataFrame) -> DataFrame:
    return functions.filter(F.col("loc") >= LARGE_FUNCTION).select("id", "name", "file", "loc").orderBy(F.desc("loc"), "id")


def complex_functions(functions: DataFrame) -> DataFrame:
    return (
        functions.filter(F.col("complexity") >= COMPLEX_FUNCTION)
        .select("id", "name", "file", "complexity")
        .orderBy(F.desc("complexity"), "id")
    )


def duplicate_names(functions: DataFrame, limit: int | None = DUPLICATE_NAME_LIMIT) -> DataFrame:
    """Names defined in more than two files, most widespread first."""
    named = functions.filter((F.col("name") != "(anonymous)") & (F.length("name") >= 3)).select("name", "file").distinct()
    out = named.groupBy("name").agg(F.count("*").alias("count")).filter(F.col("count") > DUPLICATE_NAME_FILES)
    return out.orderBy(F.desc("count"), "name").limit(limit) if limit else out


def duplicate_blocks(functions: DataFrame, limit: int | None = DUPLICATE_BLOCK_LIMIT) -> DataFrame:
    """Functions that agree in name, length, complexity and calls (a digest keeps the key short)."""
    calls = F.concat_ws(",", F.array_sort("calls")) if "calls" in functions.columns else F.lit("")
    out = (
        functions.filter(F.col("loc") >= DUPLICATE_BLOCK_LOC)
        .groupBy("name", "loc", "complexity", F.sha1(calls).alias("signature"))
        .agg(F.count("*").alias("occurrences"), F.min("file").alias("first_file"))
        .filter("occurrences > 1")
        .drop("signature")
    )
    return out.orderBy(F.desc("occurrences"), "name", "loc", "complexity", "first_file").limit(limit) if limit else out


def layered(imports: DataFrame) -> DataFrame:
    """(file, resolved, a, b): resolved imports with the layers of both files; the classifier runs once per file."""
    links = imports.filter(F.col("resolved").isNotNull()).select("file", "resolved")
    paths = links.select(F.explode(F.array("file", "resolved")).alias("path")).distinct().withColumn("layer", rules.layer_of(F.col("path")))
    return links.join(paths.select(F.col("path").alias("file"), F.col("layer").alias("a")), "file").join(
        paths.select(F.col("path").alias("resolved"), F.col("layer").alias("b")), "resolved"
    )


def layer_violations(imports: DataFrame) -> DataFrame:
    """(from, to, rule): views that reach into data or endpoints, and data that reaches into views."""
    return (
        layered(imports).select(F.col("file").alias("from"), F.col("resolved").alias("to"), "a", "b")
        .select(
            "from", "to",
            F.when((F.col("a") == "ui") & F.col("b").isin("data", "api"), F.concat(F.lit("ui imports "), F.col("b")))
            .when((F.col("a") == "data") & (F.col("b") == "ui"), "data imports ui")
            .alias("rule"),
        )
        .filter(F.col("rule").isNotNull())
    )


def layer_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(rules.layer_of(F.col("path")).alias("layer")).agg(F.count("*").alias("files"))


def lang_counts(files: DataFrame) -> DataFrame:
    return files.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("files"))


def metric_summary(files, functions, imports, cycles: DataFrame) -> DataFrame:
    """One row of list sizes; `cycles` is (id, component). Violations are counted without a cut."""
    return one_row(
        files.sparkSession,
        circular=count_of(cycles.select("component").distinct()),
        dead=count_of(dead_files(files, imports)),
        large_files=count_of(files.filter(F.col("loc") >= LARGE_FILE)),
        large_functions=count_of(functions.filter(F.col("loc") >= LARGE_FUNCTION)),
        complex_functions=count_of(functions.filter(F.col("complexity") >= COMPLEX_FUNCTION)),
        duplicate_names=count_of(duplicate_names(functions, None)),
        duplicate_blocks=count_of(duplicate_blocks(functions, None)),
        parse_errors=count_of(files.filter("has_parse_error")),
        layer_violations=count_of(layer_violations(imports)),
        undocumented=count_of(functions.filter(F.col("doc").isNull() & (F.col("loc") >= BIG_UNDOCUMENTED))),
    )


def centrality(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, fan_in, fan_out, functions, complexity, loc, score)."""
    score = (
        F.col("fan_in") * 2 + F.col("fan_out") + F.least(F.col("functions"), F.lit(20)) * 0.2 + F.least(F.col("complexity"), F.lit(80)) * 0.05
    )
    return _with_fan(files, fan_distinct(imports)).select(
        "path", "fan_in", "fan_out", "functions", "complexity", "loc", js_round(score, 1).alias("score")
    )


def risk(central: DataFrame) -> DataFrame:
    """(path, risk, fan_in, complexity, loc, reasons) for files with at least one reason."""
    cx, loc, fan = F.col("complexity"), F.col("loc"), F.col("fan_in")
    value = fan * 3 + (cx + loc * 0.02) * 0.3 + F.when(cx > 60, 15).otherwise(0) + F.when(loc > 500, 10).otherwise(0)
    reasons = F.array_compact(
        F.array(
            F.when(fan >= 5, F.concat(fan.cast("string"), F.lit(" modules depend on it"))),
            F.when(cx > 60, F.concat(F.lit("high complexity ("), cx.cast("string"), F.lit(")"))),
            F.when(loc > 500, F.concat(F.lit("large file ("), loc.cast("string"), F.lit(" LOC)"))),
            F.when((fan >= 3) & (cx > 30), F.lit("central + complex")),
        )
    )
    return central.select("path", js_round(value).cast("bigint").alias("risk"), "fan_in", "complexity", "loc", reasons.alias("reasons")).filter(
        F.size("reasons") > 0
    )


def top(df: DataFrame, by: str, n: int = TOP_MODULES, tie: str = "path") -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def heat(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Six values in [0, 1] per file, scaled by maxima over all files (scalar subqueries, floor 1)."""
    tests = internal_imports(imports).filter(rules.is_test(F.col("file"))).distinct()
    tested = tests.groupBy(F.col("resolved").alias("path")).agg(F.count("*").alias("tested"))
    m = _with_fan(files, fan_distinct(imports)).join(tested, "path", "left").fillna(0, ["tested"])
    fan_max = F.greatest(_with_fan(files, fan_distinct(imports)).agg(F.max("fan_in")).scalar(), F.lit(1))
    cx_max = F.greatest(files.agg(F.max("complexity")).scalar(), F.lit(1))
    loc_max = F.greatest(files.agg(F.max("loc")).scalar(), F.lit(1))
    f, c, s = F.col("fan_in") / fan_max, F.col("complexity") / cx_max, F.col("loc") / loc_max
    return m.select(
        "path",
        js_round(f, 4).alias("most_imported"),
        js_round((F.col("fan_in") + F.col("fan_out")) / (fan_max * 2), 4).alias("most_coupled"),
        js_round(c, 4).alias("complexity"),
        F.when(F.col("tested") > 0, 0.0).when(F.col("fan_in") > 0, 0.8).otherwise(0.4).alias("least_tested"),
        js_round(F.least(F.lit(1.0), f * 0.6 + c * 0.4), 4).alias("criticality"),
        js_round(F.least(F.lit(1.0), f * 0.4 + c * 0.3 + s * 0.3), 4).alias("risk"),
    )


def health(files, functions, imports, security, summary: DataFrame) -> DataFrame:
    """(key, value): eight scores and their mean. `summary` is the row of `metric_summary`."""
    per_file = files.agg(
        F.greatest(F.count("*"), F.lit(1)).alias("n"),
        F.count("doc").alias("documented"),
        F.count_if(rules.is_test(F.col("path"))).alias("tests"),
    )
    per_fn = functions.agg(
        F.greatest(F.count("*"), F.lit(1)).alias("fns"),
        F.count_if(F.col("loc") >= 15).alias("big"),
        F.count_if((F.col("loc") >= 15) & F.col("doc").isNotNull()).alias("big_doc"),
    )
    per_sec = security.agg(
        F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium")
    )
    fan_total = fan_distinct(imports).join(files.select("path"), "path", "left_semi").agg(F.coalesce(F.sum("fan_in"), F.lit(0)))
    n_layers = files.select(rules.layer_of(F.col("path")).alias("l")).agg(F.count_distinct("l"))
    facts = summary
    for name, df in {"n": per_file, "documented": per_file, "tests": per_file, "fns": per_fn, "big": per_fn, "big_doc": per_fn, "high": per_sec, "medium": per_sec}.items():
        facts = facts.withColumn(name, df.select(name).scalar())
    facts = facts.withColumn("fan_total", fan_total.scalar()).withColumn("layers", n_layers.scalar())
    c, one = F.col, F.lit(1.0)
    pct = lambda x: js_round(clamp01(x) * 100)
    doc = pct((c("documented") / c("n")) * 0.5 + F.coalesce(F.try_divide(c("big_doc").cast("double"), c("big")), one) * 0.5)
    testing = pct((c("tests") / c("n")) / 0.35)
    security_score = pct(one - (c("high") * 8 + c("medium") * 1.5) / F.greatest(c("n") * 2, F.lit(40)))
    complexity = pct(one - c("complex_functions") / F.greatest(c("fns") * 0.12, F.lit(20.0)))
    avg_fan = c("fan_total") / c("n")
    coupling = pct(one - (c("circular") * 0.05 + F.greatest(avg_fan - 2, F.lit(0.0)) * 0.12))
    dead = pct(one - (c("dead") / c("n")) / 0.15)
    arch = pct(
        F.when(c("circular") == 0, 0.4).otherwise(0.15)
        + F.when(c("layer_violations") == 0, 0.3).otherwise(F.greatest(F.lit(0.0), 0.3 - c("layer_violations") * 0.01))
        + F.least(c("layers") / 5, one) * 0.3
    )
    scored = facts.select(
        "n", "large_files", arch.alias("architecture"), doc.alias("documentation"), testing.alias("testing"), security_score.alias("security"),
        coupling.alias("coupling"), complexity.alias("complexity"), dead.alias("deadcode"),
    ).withColumn(
        "maintainability",
        js_round(
            (c("complexity") * 0.4 + c("documentation") * 0.25 + clamp01(one - c("large_files") / F.greatest(c("n") * 0.1, F.lit(10.0))) * 100 * 0.35)
            / 100 * 100
        ),
    )
    keys = ["architecture", "documentation", "testing", "security", "maintainability", "coupling", "complexity", "deadcode"]
    total = sum((c(k) for k in keys[1:]), c(keys[0]))
    rows = [F.struct(F.lit(k).alias("key"), c(k).cast("bigint").alias("value")) for k in keys]
    rows.append(F.struct(F.lit("overall").alias("key"), js_round(total / 8).cast("bigint").alias("value")))
    return scored.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def insight_rows(files: DataFrame, imports: DataFrame, churn: DataFrame) -> DataFrame:
    """One scored row per file; `churn` is (path, churn)."""
    cx, documented = F.col("complexity"), F.col("doc").isNotNull()
    criticality = F.col("fan_in") * 2 + F.col("fan_out") + cx * 0.05
    value = (
        F.col("fan_in") * 3 + cx * 0.3 + F.when(F.col("loc") > 500, 10).otherwise(0) + F.col("churn") * 0.8 + F.when(documented, 0).otherwise(5)
    )
    return (
        _with_fan(files, fan_statements(imports))
        .join(churn, "path", "left")
        .fillna(0, ["churn"])
        .select(
            "path", base_name(F.col("path")).alias("label"), "fan_in", "fan_out", "complexity", "loc", "churn", documented.alias("documented"),
            js_round(criticality, 1).alias("criticality"), js_round(value, 1).alias("risk"), "functions",
        )
    )


def insight_lists(rows: DataFrame, n: int = INSIGHT_LIMIT) -> DataFrame:
    """(list, path, value): eight ranked lists, each an independent bounded top-k."""
    # List name, ranking value, filter.
    specs: list[tuple[str, Column, Column]] = [
        ("most_critical", F.col("criticality"), F.lit(True)),
        ("most_complex", F.col("complexity"), F.lit(True)),
        ("most_coupled", F.col("fan_in") + F.col("fan_out"), F.lit(True)),
        ("most_modified", F.col("churn"), F.lit(True)),
        ("least_documented", F.col("fan_in"), ~F.col("documented") & (F.col("functions") >= 2)),
        ("highest_risk", F.col("risk"), F.lit(True)),
        ("most_unstable", F.col("churn") * F.col("fan_in"), F.col("churn") > 0),
        ("fastest_growing", F.col("churn"), F.col("loc") > 100),
    ]
    out = None
    for name, value, keep in specs:
        part = rows.filter(keep).select(F.lit(name).alias("list"), "path", value.cast("double").alias("value")).orderBy(F.desc("value"), "path").limit(n)
        out = part if out is None else out.unionByName(part)
    return out
