"""Declared dependencies from package manifests, as one projection over manifest texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.text import base_name

_DEP = "array<struct<name:string,version:string,scope:string>>"
# Manifest file -> ecosystem.
ECOSYSTEMS = {
    "package.json": "npm", "requirements.txt": "pip", "go.mod": "go", "Cargo.toml": "cargo", "composer.json": "composer", "pom.xml": "maven",
    "build.gradle": "gradle", "Gemfile": "bundler", "pubspec.yaml": "pub", "pyproject.toml": "python",
}


def _entries(text: Column, key: str, scope: str) -> Column:
    """Entries of one object of a JSON document."""
    m = F.from_json(F.get_json_object(text, f"$.{key}"), "map<string,string>")
    out = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(scope).alias("scope")))
    return F.coalesce(out, F.array().cast(_DEP))


def _names(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("").alias("version"), F.lit("runtime").alias("scope")))


def _all(text: Column, rx: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rx), F.lit(1))


def _requirements(text: Column) -> Column:
    rx = r"^([A-Za-z0-9._-]+)\s*([<>=!~].*)?"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda v: F.trim(v)), lambda l: (l != "") & ~l.startswith("#") & l.rlike(rx))
    version = lambda l: F.trim(F.regexp_extract(l, rx, 2))
    return F.transform(
        lines,
        lambda l: F.struct(
            F.regexp_extract(l, rx, 1).alias("name"), F.when(version(l) == "", "*").otherwise(version(l)).alias("version"), F.lit("runtime").alias("scope")
        ),
    )


def manifests(files: DataFrame) -> DataFrame:
    """(file, ecosystem, name, version, deps) of every known manifest."""
    t, base = F.col("text"), base_name(F.col("path"))
    section = lambda rx: F.regexp_extract(t, rx, 1)
    deps = {
        "package.json": F.concat(_entries(t, "dependencies", "runtime"), _entries(t, "devDependencies", "dev"), _entries(t, "peerDependencies", "peer")),
        "requirements.txt": _requirements(t),
        "go.mod": _names(F.filter(_all(t, r"(?m)^\s*(?:require\s+)?([\w.\-/]+)\s+v[\w.\-+]+"), lambda n: n.contains("/"))),
        "Cargo.toml": _names(_all(section(r"\[dependencies\]([\s\S]*?)(?:\n\[|$(?![\s\S]))"), r"(?m)^([\w-]+)\s*=")),
        "composer.json": _entries(t, "require", "runtime"),
        "pom.xml": _names(_all(t, r"<artifactId>([^<]+)</artifactId>")),
        "build.gradle": _names(
            F.transform(
                _all(t, r"(?:implementation|api|compile|testImplementation)\s+[`'\"]([^`'\"]+)[`'\"]"), lambda n: F.array_join(F.slice(F.split(n, ":"), 1, 2), ":")
            )
        ),
        "Gemfile": _names(_all(t, r"(?m)^\s*gem\s+[`'\"]([^`'\"]+)[`'\"]")),
        "pubspec.yaml": _names(_all(section(r"(?m)^dependencies:[ \t]*\n((?:[ \t]+.*\n?|\n)*)"), r"(?m)^ {2}([\w-]+):")),
        "pyproject.toml": _names(_all(t, r"(?m)^\s*([\w.-]+)\s*=\s*[`'\"][^`'\"]+[`'\"]")),
    }
    chosen: Column = F.lit(None).cast(_DEP)
    for name, expr in deps.items():
        chosen = F.when(base == name, expr.cast(_DEP)).otherwise(chosen)
    eco = F.element_at(F.create_map(*[F.lit(x) for kv in ECOSYSTEMS.items() for x in kv]), base)
    is_npm = base == "package.json"
    return files.filter(base.isin(list(ECOSYSTEMS))).select(
        F.col("path").alias("file"), eco.alias("ecosystem"), F.when(is_npm, F.get_json_object(t, "$.name")).alias("name"),
        F.when(is_npm, F.get_json_object(t, "$.version")).alias("version"), F.coalesce(chosen, F.array().cast(_DEP)).alias("deps"),
    )


def dependencies(found: DataFrame) -> DataFrame:
    """(name, version, scope, ecosystem, from): the first entry of a name inside each manifest."""
    names = F.transform("deps", lambda d: d["name"])
    first = F.filter("deps", lambda d, i: F.array_position(names, d["name"]) == i + 1)
    return found.select("file", "ecosystem", F.explode(first).alias("d")).select("d.name", "d.version", "d.scope", "ecosystem", F.col("file").alias("from"))
