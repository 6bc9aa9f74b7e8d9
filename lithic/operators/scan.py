"""Row generators over file text: routes, database access, environment, security, jobs, infra.

Input rows are (path, text, ...). One projection collects the matches of every pattern of a family
into an array and explodes it: no shuffle, whole texts, all matches. The 1-based line of a match
comes from folding over the pieces between matches, so patterns may span lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions import patterns as P
from lithic.functions import rules
from lithic.functions.patterns import Pattern
from lithic.functions.text import extension, redact

_MARK = "\ue000"
_MATCH = "array<struct<spec:int,line:bigint,hit:string>>"


def matches(text: Column, regex: str, spec: int, when: Column | None = None) -> Column:
    """array<struct<spec, line, hit>> of all matches of one pattern.

    A mark is put before each match; the lines that hold marks then give the matches their lines, in one pass.
    """
    marked = F.split(F.regexp_replace(F.translate(text, _MARK, " "), regex, f"{_MARK}$0"), "\n", -1)
    marks = lambda row: F.length(row) - F.length(F.translate(row, _MARK, ""))
    lines = F.flatten(F.transform(marked, lambda row, i: F.array_repeat((i + 1).cast("bigint"), marks(row))))
    found = F.zip_with(lines, F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda at, hit: F.struct(F.lit(spec).alias("spec"), at.alias("line"), hit.alias("hit")))
    present = text.rlike(regex) if when is None else when & text.rlike(regex)
    return F.when(present, found).otherwise(F.array().cast(_MATCH))


def scan(files: DataFrame, specs: list[tuple[str, Column | None]], text: str = "text") -> DataFrame:
    """All matches of several patterns: input columns without the text, plus spec, line, hit, pos."""
    found = F.concat(*[matches(F.col(text), rx, i, guard) for i, (rx, guard) in enumerate(specs)])
    kept = [c for c in files.columns if c != text]
    return files.select(*kept, F.posexplode(found).alias("pos", "m")).select(
        *kept, "pos", F.col("m.spec").alias("spec"), F.col("m.line").alias("line"), F.col("m.hit").alias("hit")
    )


def per_spec(values: list, default=None) -> Column:
    """Value of the matching pattern by its position."""
    out = F.lit(default)
    for i, v in enumerate(values):
        out = F.when(F.col("spec") == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _capture(specs: list[Pattern], name: str) -> Column:
    return per_spec(
        [
            F.regexp_extract("hit", p.regex, p.groups[name]) if name in p.groups else F.lit(None).cast("string")
            for p in specs
        ]
    )


def file_routes(files: DataFrame) -> DataFrame:
    """Routes implied by file names of three web frameworks; verbs come from exported handlers."""
    p = F.col("path")
    param = lambda c: F.regexp_replace(F.regexp_replace(c, r"\[\.\.\.([^\]]+)\]", ":$1*"), r"\[([^\]]+)\]", ":$1")
    app, pages, kit = (
        r"(?:^|/)(?:src/)?app/(?:(.*)/)?route\.(?:ts|js|tsx|jsx)$",
        r"(?:^|/)(?:src/)?pages/(.*)\.(?:ts|js|tsx|jsx)$",
        r"(?:^|/)src/routes/(?:(.*)/)?\+(?:server|page)\.(?:ts|js)$",
    )
    page = F.regexp_extract(p, pages, 1)
    is_page = p.rlike(pages) & ~F.element_at(F.split(page, "/"), -1).startswith("_")
    route = (
        F.when(p.rlike(app), F.concat(F.lit("/"), param(F.regexp_replace(F.regexp_extract(p, app, 1), r"\([^)]*\)(/|$)", ""))))
        .when(is_page, F.concat(F.lit("/"), param(F.regexp_replace(page, r"(^|/)index$", ""))))
        .when(p.rlike(kit), F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract(p, kit, 1), r"\[([^\]]+)\]", ":$1")))
    )
    framework = F.when(p.rlike(app), "nextjs-app").when(is_page, "nextjs-pages").when(p.rlike(kit), "sveltekit")
    verbs = F.regexp_extract_all("text", F.lit(P.EXPORTED_VERB), F.lit(1))
    return (
        files.select(p.alias("file"), route.alias("path"), framework.alias("framework"), verbs.alias("verbs"))
        .filter(F.col("path").isNotNull())
        .select(
            F.explode(F.when(F.size("verbs") > 0, F.col("verbs")).otherwise(F.array(F.lit("GET")))).alias("method"),
            "path", "framework", "file", F.lit(1).cast("bigint").alias("line"), F.lit(-1).alias("prio"),
        )
    )


def detect_routes(files: DataFrame) -> DataFrame:
    """(method, path, framework, file, line, prio). A Python decorator outranks the generic call form."""
    found = scan(files, [(p.regex, None) for p in P.ROUTES])
    verb = F.upper(F.coalesce(_capture(P.ROUTES, "method"), F.lit("ANY")))
    framework = per_spec([p.label for p in P.ROUTES])
    python_first = (F.col("framework") == "python-web") & F.col("file").endswith(".py")
    text_routes = (
        found.select(
            F.when(verb.isin("ROUTE", "REQUEST"), "ANY").otherwise(verb).alias("method"),
            _capture(P.ROUTES, "path").alias("path"),
            framework.alias("framework"), F.col("path").alias("file"), "line", "spec", "pos",
        )
        .filter((F.length("path") > 0) & (F.length("path") <= 200))
        .select("method", "path", "framework", "file", "line", F.when(python_first, F.lit(0)).otherwise(F.col("spec") + 1).alias("prio"))
    )
    return file_routes(files).unionByName(text_routes)


def detect_db(files: DataFrame) -> DataFrame:
    """(kind, table, op, file, line): mapper calls everywhere, statements in .sql files, SQL in strings elsewhere."""
    is_sql = extension(F.col("path")) == ".sql"
    text = F.col("text")
    specs = [*P.DB, P.SQL_DDL, P.SQL_DML, P.SQL_IN_STRING]
    guards = [text.rlike(p.needs) if p.needs else None for p in P.DB]
    guards += [is_sql, is_sql, ~is_sql & text.rlike(P.SQL_IN_STRING.needs)]
    n = len(P.DB)
    kind = per_spec(
        [p.label for p in specs[:-1]]
        + [F.when(F.lower("hit").rlike("insert|update|delete"), "sql-write").otherwise("sql")]
    )
    table = F.col("table")
    stop = (
        F.when(F.col("spec") < n, table.rlike(P.DB_STOP) | (F.length(table) > 64))
        .when(F.col("spec") == n + 1, table.rlike(P.DML_STOP))
        .when(F.col("spec") == n + 2, table.rlike(P.SQL_STRING_STOP))
        .otherwise(F.lit(False))
    )
    return (
        scan(files, [(p.regex, g) for p, g in zip(specs, guards)])
        .withColumn("table", _capture(specs, "table"))
        .filter(~stop)
        .select(kind.alias("kind"), "table", _capture(specs, "op").alias("op"), F.col("path").alias("file"), "line")
    )


def detect_env(files: DataFrame) -> DataFrame:
    """(name, file, line): the first occurrence of each variable in a file, decided inside the row."""
    found = F.concat(*[matches(F.col("text"), rx, i) for i, rx in enumerate(P.ENV)])

    def named(m: Column) -> Column:
        name = F.lit(None).cast("string")
        for i, rx in enumerate(P.ENV):
            name = F.when(m["spec"] == i, F.regexp_extract(m["hit"], rx, 1)).otherwise(name)
        return F.struct(name.alias("name"), m["line"].alias("line"))

    hits = files.select(F.col("path").alias("file"), F.transform(found, named).alias("hits"))
    names = F.transform("hits", lambda h: h["name"])
    first = F.filter("hits", lambda h, i: F.array_position(names, h["name"]) == i + 1)
    return hits.filter(F.size("hits") > 0).select("file", F.explode(first).alias("h")).select("h.name", "file", "h.line")


def detect_security(files: DataFrame) -> DataFrame:
    """(type, kind, severity, file, line, snippet): secrets (redacted) and dangerous calls."""
    specs = [*P.SECRETS, *P.DANGEROUS]
    secret = F.col("spec") < len(P.SECRETS)
    example = secret & F.col("path").rlike(P.EXAMPLE_FILE)
    return scan(files, [(p.regex, None) for p in specs]).select(
        F.when(secret, "secret").otherwise(per_spec([p.category for p in specs])).alias("type"),
        F.concat(per_spec([p.label for p in specs]), F.when(example, " (example file)").otherwise("")).alias("kind"),
        F.when(example, "low").otherwise(per_spec([p.severity for p in specs])).alias("severity"),
        F.col("path").alias("file"),
        "line",
        F.when(secret, redact(F.col("hit"))).alias("snippet"),
    )


def detect_jobs(files: DataFrame) -> DataFrame:
    return scan(files, [(p.regex, None) for p in P.JOBS]).select(
        per_spec([p.label for p in P.JOBS]).alias("kind"), _capture(P.JOBS, "detail").alias("detail"), F.col("path").alias("file"), "line"
    )


def detect_infra(files: DataFrame) -> DataFrame:
    kind, system = rules.infra_rule(F.col("path"))
    return files.select(kind.alias("type"), system.alias("system"), F.col("path").alias("file")).filter(F.col("type").isNotNull())


def source_lines(files: DataFrame, path: str, start: int, end: int | None = None) -> DataFrame:
    """A line range of one file, 31 lines when no end is given."""
    last = end if end is not None else start + 30
    return (
        files.filter(F.col("path") == path)
        .select(F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
        .select((F.col("i") + 1).cast("bigint").alias("line"), "text")
        .filter(F.col("line").between(start, last))
    )
