"""Functions, classes, imports, calls and file records from source text.

Everything about one file is computed inside its row and only small records are exploded, so the
stage is a single pass over the text without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.blocks import code_blocks
from lithic.functions.languages import ANONYMOUS, CALL, CODE_LANGUAGES, COMMENT_LINE, GRAMMARS, NOT_CALLS
from lithic.functions.rules import first_match
from lithic.functions.text import squeeze
from lithic.operators.scan import matches

DOC_MARKERS = r"(?m)/\*\*?|\*/|^\s*\*\s?|^\s*//\s?|^\s*#\s?"
MAX_CALL = 80
MAX_DOC = 400
MAX_RAW = 200
#: The name of functions that have none.
NAMELESS = "(anonymous)"


def _by_lang(values: dict[str, str], lang: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), lang)


def parse(files: DataFrame) -> DataFrame:
    """Add masked code, raw and masked lines and block ends to the code files."""
    lang = F.col("lang")
    parsed = files.filter(lang.isin(list(GRAMMARS))).withColumn(
        "b", code_blocks("text", "lang", _by_lang({k: g.style for k, g in GRAMMARS.items()}, lang))
    )
    return parsed.select(
        *[c for c in files.columns],
        F.col("b.code").alias("code"),
        F.col("b.ends").alias("ends"),
        F.col("b.above").alias("above"),
        F.split("text", "\n", -1).alias("lines"),
        F.split("b.code", "\n", -1).alias("code_lines"),
    )


def _comment(lines: Column, line: Column) -> Column:
    """Comment run directly above a line, markers removed."""
    n = F.element_at(F.col("above"), line)
    return squeeze(F.regexp_replace(F.array_join(F.slice(lines, line - n, n), "\n"), DOC_MARKERS, ""))


def _some(text: Column) -> Column:
    """At most 400 characters of a comment, or null if it is empty."""
    return F.when(F.length(text) > 0, F.substring(text, 1, MAX_DOC))


def _doc_above(lines: Column, line: Column) -> Column:
    return _some(_comment(lines, line))


def _closed(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[(\[{]")) <= F.regexp_count(text, F.lit(r"[)\]}]"))


def _stepwise(rows: Column, names: list[str], steps: list[Callable[[Column], dict[str, Column]]]) -> Column:
    """Structs with more fields, step by step: a lambda computes an expression as often as it names it, a field of an earlier step is there."""
    for step in steps:

        def grown(m: Column) -> Column:
            nonlocal names
            new = step(m)  # noqa: B023 (called at once)
            kept = [n for n in names if n not in new]
            names = [*kept, *new]
            return F.struct(*(m[n].alias(n) for n in kept), *(v.alias(n) for n, v in new.items()))

        rows = F.transform(rows, grown)
    return rows


def _call_names(code: Column) -> Column:
    skip = F.array(*[F.lit(w) for w in NOT_CALLS])
    return F.filter(
        F.array_distinct(F.regexp_extract_all(code, F.lit(CALL), F.lit(1))),
        lambda n: ~F.array_contains(skip, n) & (F.length(n) < MAX_CALL),
    )


def _defs(kind: str, only: list[str] | None) -> tuple[Column, list[tuple[str, str]]]:
    """Matches of the definition patterns of all (or only some) languages plus (name regex, class kind) per pattern."""
    groups: dict[tuple[str, str], list[str]] = {}
    for lang, g in GRAMMARS.items():
        if only is not None and lang not in only:
            continue
        for k, rx in [("function", r) for r in g.functions] if kind == "function" else g.classes:
            groups.setdefault((k, rx), []).append(lang)
    found = [
        matches(F.col("code"), rx, i, F.col("lang").isin(langs)) for i, ((_, rx), langs) in enumerate(groups.items())
    ]
    return F.concat(*found), [(rx, k) for k, rx in groups]


def _span(m: Column) -> tuple[Column, Column]:
    line = m["line"].cast("int")
    return line, F.greatest(F.element_at(F.col("ends"), line), line)


def functions(parsed: DataFrame, only: list[str] | None = None, body: bool = False) -> DataFrame:
    """(id, file, lang, name, line, end_line, loc, complexity, calls, doc, async), with `body` also the lines as a text."""
    found, specs = _defs("function", only)
    hit = lambda m: F.length(m["hit"]) + 1
    # Definition patterns are anchored at the line start, so the rest of the line, and of the body, follows the hit.
    steps = [
        lambda m: {"at": m["line"].cast("int"), "row": F.element_at(F.col("code_lines"), m["line"].cast("int"))},
        lambda m: {"after": F.substr(m["row"], hit(m)), "end": F.greatest(F.element_at(F.col("ends"), m["at"]), m["at"])},
        # An arrow whose body is an expression that its line completes ends there.
        lambda m: {"end": F.when(m["hit"].rlike(r"=>\s*$") & m["after"].rlike(r"^\s*[^\s{]") & _closed(m["after"]), m["at"]).otherwise(m["end"])},
        lambda m: {"body": F.array_join(F.slice(F.col("code_lines"), m["at"], m["end"] - m["at"] + 1), "\n"), "doc": _comment(F.col("lines"), m["at"])},
    ]
    record = lambda m: F.struct(
        first_spec_name(m, specs).alias("name"),
        m["at"].cast("bigint").alias("line"),
        m["end"].cast("bigint").alias("end_line"),
        (m["end"] - m["at"] + 1).cast("bigint").alias("loc"),
        (F.regexp_count(m["body"], F.col("branch")) + 1).cast("bigint").alias("complexity"),
        _call_names(F.substr(m["body"], hit(m))).alias("calls"),
        _some(m["doc"]).alias("doc"),
        F.substring(m["row"], 1, 40).rlike(r"\basync\b").alias("async"),
    )

    rows = parsed.withColumn("branch", _by_lang({k: g.branch for k, g in GRAMMARS.items()}, F.col("lang"))).select(
        F.col("path").alias("file"), "lang", *(["lines"] if body else []), F.explode(F.transform(_stepwise(found, ["spec", "line", "hit"], steps), record)).alias("f")
    )
    own = F.array_join(F.slice("lines", F.col("f.line").cast("int"), F.col("f.loc").cast("int")), "\n").alias("body")
    # A typed definition and a constructor pattern can hit the same line; one record per (file, line, name).
    return (
        rows.select("file", "lang", "f.*", *([own] if body else []))
        .filter(F.length("name") > 0)
        .withColumn("id", F.concat("file", F.lit("::"), "name", F.lit("#"), F.col("line").cast("string")))
        .dropDuplicates(["id"])
    )


def first_spec_name(m: Column, specs: list[tuple[str, str]]) -> Column:
    out = F.lit("")
    for i, (rx, _) in enumerate(specs):
        name = F.lit(NAMELESS) if rx == ANONYMOUS else F.regexp_extract(m["hit"], rx, 1)
        out = F.when(m["spec"] == i, name).otherwise(out)
    return out


def classes(parsed: DataFrame, only: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, file, lang, name, kind, line, end_line, loc, doc) and the columns of the file to keep."""
    found, specs = _defs("class", only)

    def record(m: Column) -> Column:
        line, end = _span(m)
        return F.struct(
            first_spec_name(m, specs).alias("name"),
            first_match([(m["spec"] == i, k) for i, (_, k) in enumerate(specs)], "class").alias("kind"),
            line.cast("bigint").alias("line"),
            end.cast("bigint").alias("end_line"),
            (end - line + 1).cast("bigint").alias("loc"),
            _doc_above(F.col("lines"), line).alias("doc"),
        )

    return parsed.select(F.col("path").alias("file"), "lang", *keep, F.explode(F.transform(found, record)).alias("c")).select(
        F.concat("file", F.lit("::"), F.col("c.name")).alias("id"), "file", "lang", "c.*", *keep
    )


def imports(parsed: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(file, source, raw, line): the quoted module, else the word after the import keyword."""
    groups: dict[str, list[str]] = {}
    for lang, g in GRAMMARS.items():
        if only is not None and lang not in only:
            continue
        for rx in g.imports:
            groups.setdefault(rx, []).append(lang)
    found = F.concat(*[matches(F.col("text"), rx, i, F.col("lang").isin(langs)) for i, (rx, langs) in enumerate(groups.items())])
    whole = squeeze(F.col("m.hit"))
    raw = F.substring(whole, 1, MAX_RAW)
    quoted = F.regexp_extract(whole, r"['\"<]([^'\"<>]+)['\">]", 1)
    word = F.regexp_extract(whole, r"(?i)(?:from|import|use|using|require|alias)\s+(?:static\s+)?([\w./:\\-]+)", 1)
    return parsed.select(F.col("path").alias("file"), F.explode(found).alias("m")).select(
        "file",
        F.when(F.length(quoted) > 0, quoted).when(F.length(word) > 0, word).alias("source"),
        raw.alias("raw"),
        F.col("m.line").alias("line"),
    )


def file_calls(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file"), _call_names(F.col("code")).alias("calls"))


def file_records(files: DataFrame, fns: DataFrame) -> DataFrame:
    """(path, lang, meta, size, loc, sloc, functions, complexity, doc) for code, data and meta files."""
    lines = F.split("text", "\n", -1)
    sloc = F.size(F.filter(lines, lambda s: (F.trim(s) != "") & ~s.rlike(COMMENT_LINE)))
    is_code = F.col("lang").isin(list(CODE_LANGUAGES))
    head = lines
    plain = F.array_position(F.transform(head, lambda s: s.rlike(COMMENT_LINE)), F.lit(False)).cast("int")
    run = F.slice(head, 1, F.when(plain == 0, F.size(head)).otherwise(plain - 1))
    doc = squeeze(F.regexp_replace(F.array_join(run, "\n"), DOC_MARKERS, ""))
    base = files.filter(F.col("lang").isNotNull() | F.col("meta").isNotNull()).select(
        "path",
        F.coalesce("lang", F.lit("other")).alias("lang"),
        "meta",
        "size",
        F.size(lines).cast("bigint").alias("loc"),
        F.when(is_code, sloc).otherwise(F.size(lines)).cast("bigint").alias("sloc"),
        F.when(is_code & (F.length(doc) > 0), F.substring(doc, 1, MAX_DOC)).alias("doc"),
    )
    per_file = fns.groupBy(F.col("file").alias("path")).agg(
        F.count("*").alias("functions"), F.sum("complexity").alias("complexity")
    )
    return base.join(per_file, "path", "left").fillna(0, ["functions", "complexity"])


def broken(parsed: DataFrame) -> DataFrame:
    """(path): files with brackets that do not pair up, outside comments and strings.

    The depth of each kind of bracket is a running sum over the file that may not fall below zero and ends there. Languages whose
    blocks end by a word are left out, as their case labels have lone brackets.
    """
    kinds = ("()", "[]", "{}")
    marks = F.regexp_extract_all(F.col("code"), F.lit(r"[()\[\]{}]"), F.lit(0))
    step = lambda acc, m: F.struct(
        *((acc[f"d{i}"] + F.when(m == a, 1).when(m == b, -1).otherwise(0)).alias(f"d{i}") for i, (a, b) in enumerate(kinds)),
        F.least(acc["low"], *(acc[f"d{i}"] - F.when(m == b, 1).otherwise(0) for i, (_, b) in enumerate(kinds))).alias("low"),
    )
    zero = F.struct(*(F.lit(0).alias(f"d{i}") for i in range(len(kinds))), F.lit(0).alias("low"))
    depth = F.aggregate(marks, zero, step)
    word_ends = [lang for lang, g in GRAMMARS.items() if g.style == "end"]
    checked = parsed.filter(~F.col("lang").isin(word_ends)).select("path", depth.alias("d"))
    return checked.filter((F.col("d.low") < 0) | (F.col("d.d0") != 0) | (F.col("d.d1") != 0) | (F.col("d.d2") != 0)).select("path")
