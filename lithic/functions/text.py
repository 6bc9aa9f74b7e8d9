"""Column expressions for strings, paths and rounding. Everything stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lc(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def js_round(c: Column, digits: int = 0) -> Column:
    """Half-up toward +infinity: floor(x * 10^d + 0.5) / 10^d, as a double."""
    scale = float(10**digits)
    return F.floor(c.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """'.ext' of the base name; a leading dot alone is not an extension."""
    return F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1)


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_case(c: Column) -> Column:
    """Upper-case the first character of each word run and keep the rest as it is."""
    runs = F.regexp_extract_all(c, F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.when(r.rlike(r"^\w"), F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))).otherwise(r),
        ),
        "",
    )


def camel_to_snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"))


def simple_type(c: Column) -> Column:
    """Drop generics, array brackets and the package of a type name."""
    bare = F.regexp_replace(F.regexp_replace(c, r"<.*>", ""), r"\[\]", "")
    return F.trim(F.element_at(F.split(bare, r"\."), -1))


def path_tokens(path: Column) -> Column:
    """Lower-cased tokens of a path without extension, split on / _ - and ."""
    return F.filter(F.split(strip_extension(F.lower(path)), r"[/_\-.]+"), lambda t: t != "")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1)).cast("long")


def contains_any(hay: Column, needles: list[str]) -> Column:
    """True when one of a short fixed list of needles occurs in the text."""
    if not needles:
        return F.lit(False)
    out = hay.contains(needles[0])
    for n in needles[1:]:
        out = out | hay.contains(n)
    return out


def normalise_path(path: Column) -> Column:
    """Resolve '.' and '..' segments; leading '..' beyond the root are dropped."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..",
            F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(folded, "/")


def redact(c: Column) -> Column:
    """Short secrets keep 3 leading characters; longer ones 6 leading and 3 trailing."""
    return F.when(F.length(c) <= 10, F.concat(F.substring(c, 1, 3), F.lit("***"))).otherwise(
        F.concat(F.substring(c, 1, 6), F.lit("***"), F.substring(c, -3, 3))
    )


def normalise_repo_url(url: Column) -> Column:
    """scp form to https, page suffixes stripped, '.git' appended for the three known hosts; else null."""
    u = F.trim(url)
    scp = r"^git@([^:]+):(.+?)(\.git)?$"
    as_https = F.concat(
        F.lit("https://"), F.regexp_extract(u, scp, 1), F.lit("/"), F.regexp_extract(u, scp, 2), F.lit(".git")
    )
    page = F.regexp_replace(F.regexp_replace(u, r"/(tree|blob)/[^/]+.*$", ""), r"/+$", "")
    hosted = u.rlike(r"github\.com|gitlab\.com|bitbucket\.org") & ~u.endswith(".git")
    return (
        F.when(u.rlike(scp), as_https)
        .when(u.rlike(r"^https?://") & hosted, F.concat(page, F.lit(".git")))
        .when(u.rlike(r"^https?://"), u)
    )


def repo_dir_name(url: Column) -> Column:
    """Last two URL segments joined by '__' plus a 12-character SHA-1 prefix."""
    segments = F.split(F.regexp_replace(url, r"\.git$", ""), "[/:]")
    last_two = F.array_join(F.slice(segments, -2, 2), "__")
    return F.concat(F.regexp_replace(last_two, r"[^\w.-]", "_"), F.lit("-"), F.substring(F.sha1(url), 1, 12))


def repo_id(source: Column, ref: Column) -> Column:
    return F.substring(F.sha1(F.concat(source, F.lit("@"), F.coalesce(ref, F.lit("")))), 1, 12)
