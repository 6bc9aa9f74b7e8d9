"""Import and call resolution as equi-joins on derived keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.text import base_name, dir_name, extension, normalise_path, strip_extension
from lithic.session import cut

# Extensions and index names tried for a relative import, in order of preference.
CODE_EXTS = ".ts .tsx .js .jsx .mjs .cjs .py .go .rs .java .kt .rb .php .cs .c .cpp .h .hpp .swift .dart .scala .ex .exs .lua".split()
INDEX_NAMES = ["index", "mod", "__init__", "main"]
_STRIPPED = 1000  # rank offset of the retry without the written extension


def _rank(values: list[str], c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), c).cast("int")


def file_keys(files: DataFrame) -> DataFrame:
    """(key, rank, path): a file is reached by its path, its stem, or its folder when it is an index."""
    ext = _rank(CODE_EXTS, extension(F.col("path")))
    idx = _rank(INDEX_NAMES, strip_extension(base_name(F.col("path"))))
    keys = F.array(
        F.struct(F.col("path").alias("key"), F.lit(0).alias("rank")),
        F.when(ext > 0, F.struct(strip_extension(F.col("path")).alias("key"), ext.alias("rank"))),
        F.when(
            (ext > 0) & (idx > 0),
            F.struct(dir_name(F.col("path")).alias("key"), (idx * 100 + ext).alias("rank")),
        ),
    )
    return files.select("path", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select(
        "k.key", "k.rank", F.col("path").alias("hit")
    )


def _python_relative(source: Column) -> Column:
    """'.a.b' -> './a/b' and '..a' -> '../a', so that dotted relative modules resolve like paths."""
    dots = F.length(F.regexp_extract(source, r"^(\.+)", 1))
    rest = F.regexp_replace(F.regexp_replace(source, r"^\.+", ""), r"\.", "/")
    return F.concat(F.lit("./"), F.repeat(F.lit("../"), dots - 1), rest)


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Best file for each distinct (file, source) whose source starts with a dot.

    Instead of spelling out every candidate path per import, both sides carry at most three keys, and
    the candidate order survives as the rank that the final minimum picks.
    """
    spec = F.when(
        F.col("file").endswith(".py") & ~F.col("source").contains("/"), _python_relative(F.col("source"))
    ).otherwise(F.col("source"))
    target = normalise_path(F.concat(dir_name(F.col("file")), F.lit("/"), spec))
    wanted = (
        imports.filter(F.col("source").startswith("."))
        .select("file", "source")
        .distinct()
        .withColumn("target", target)
        .select(
            "file",
            "source",
            F.explode(
                F.array(
                    F.struct(F.col("target").alias("key"), F.lit(0).alias("base")),
                    F.struct(strip_extension(F.col("target")).alias("key"), F.lit(_STRIPPED).alias("base")),
                )
            ).alias("w"),
        )
    )
    found = (
        wanted.select("file", "source", "w.key", "w.base")
        .join(file_keys(files), "key")
        # The retry looks only for stem + extension, ranks 1 to 99.
        .filter((F.col("base") == 0) | F.col("rank").between(1, 99))
    )
    return found.groupBy("file", "source").agg(
        F.min_by("hit", F.struct(F.col("base") + F.col("rank"), F.col("hit"))).alias("resolved")
    )


def suffix_index(files: DataFrame) -> DataFrame:
    """(key, path) of the 1- to 3-segment suffixes that belong to exactly one file."""
    segs = F.split(strip_extension(F.col("path")), "/")
    keys = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(3), F.size(segs))), lambda n: F.array_join(F.slice(segs, -n, n), "/")
    )
    return (
        files.select("path", F.explode(F.array_distinct(keys)).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min("path").alias("hit"))
        .filter("n = 1")
        .select("key", "hit")
    )


def resolve_package(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Package-style sources by unambiguous suffix: dotted form before slashed, longer before shorter."""
    norm = F.regexp_replace(F.regexp_replace(F.col("source"), r"\\", "/"), r"^@[\w-]+/", "")
    dotted = F.regexp_replace(norm, r"\.", "/")

    def keys(spec: Column, offset: int) -> Column:
        segs = F.filter(F.split(spec, "/"), lambda s: s != "")
        n = F.least(F.lit(3), F.size(segs))
        return F.transform(
            F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.array_join(F.slice(segs, -i, i), "/").alias("key"), (F.lit(offset + 3) - i).alias("rank")),
        )

    wanted = (
        imports.filter(F.col("source").isNotNull() & ~F.col("source").startswith("."))
        .select("source")
        .distinct()
        .select("source", F.explode(F.concat(keys(dotted, 0), keys(norm, 10))).alias("w"))
        .select("source", "w.key", "w.rank")
    )
    return wanted.join(suffix_index(files), "key").groupBy("source").agg(F.min_by("hit", "rank").alias("resolved"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Add (resolved, external) to imports(file, source, ...). A file never resolves to itself by suffix."""
    rel = resolve_relative(imports, files).withColumnRenamed("resolved", "rel_hit")
    pkg = resolve_package(imports, files).withColumnRenamed("resolved", "pkg_hit")
    joined = imports.join(rel, ["file", "source"], "left").join(pkg, "source", "left")
    hit = F.coalesce("rel_hit", F.when(F.col("pkg_hit") != F.col("file"), F.col("pkg_hit")))
    return joined.withColumn("resolved", hit).withColumn("external", F.col("resolved").isNull()).drop("rel_hit", "pkg_hit")


def imported_by(imports: DataFrame) -> DataFrame:
    """Distinct (path, importer) reverse edges."""
    return (
        imports.filter(F.col("resolved").isNotNull())
        .select(F.col("resolved").alias("path"), F.col("file").alias("importer"))
        .distinct()
    )


BUCKETS = 65536  # Fixed value: names travel along imports as 16-bit buckets; the names themselves decide afterwards.


def _digest(path: Column, end: str) -> list[Column]:
    """128 bits that stand for a path in joins, as two columns."""
    return [F.xxhash64(path).alias(f"{end}1"), F.xxhash64(F.lit(1), path).alias(f"{end}2")]


def _bucket(name: Column) -> Column:
    return (F.pmod(F.xxhash64(name), F.lit(BUCKETS)) - BUCKETS // 2).cast("smallint")


def label_ends(call_edges: DataFrame, labels: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target): the labels of both ends of each edge, from labels(id, label). Ids travel as digests, labels are short."""
    named = labels.filter(F.col("id").isNotNull()).select(*_digest(F.col("id"), "i"), "label")
    end = lambda e, name: named.select(F.col("i1").alias(e + "1"), F.col("i2").alias(e + "2"), F.col("label").alias(name))
    ids = call_edges.select(*_digest(F.col("src"), "s"), *_digest(F.col("dst"), "d"))
    return ids.join(end("s", source), ["s1", "s2"]).select("d1", "d2", source).join(end("d", target), ["d1", "d2"]).select(source, target)


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst) call edges.

    A name that one function has wins; otherwise the caller's own file, then the files it imports, each
    by the earliest function. Joining on the name alone would pair every call of a common name with
    every definition of it, so ambiguous names are only joined together with a file. The only function of
    a name in the caller's own file is the local one, so the own file can be asked first.
    """
    # Functions and calls meet by file alone: the rows of a file travel next to each other, and what they share is packed away.
    defs = functions.select("file", "name", F.struct("ord", "id").alias("def"))
    placed = cut(
        defs.unionByName(calls.select("file", "name", "caller_id"), allowMissingColumns=True)
        .repartition("file")
        .groupBy("file", "name")
        .agg(F.min("def").alias("def"), F.count("def").alias("n"), F.collect_set("caller_id").alias("callers"))
    )
    by_file = placed.filter("n > 0").select("file", "name", "def.id", "def.ord", "n")
    by_name = by_file.groupBy("name").agg(F.sum("n").alias("n"), F.min("id").alias("only"))
    local = F.col("def.id").isNotNull() & F.col("file").isNotNull() & F.col("name").isNotNull()
    asked = placed.filter(F.size("callers") > 0)
    same_file = asked.filter(local).select("callers", F.col("def.id").alias("dst"))
    known = cut(asked.filter(~local).select("file", "name", "callers").join(by_name, "name"))
    unique = known.filter("n = 1").select("callers", F.col("only").alias("dst"))
    # One row a file, under a short number for the two joins that follow.
    open_calls = cut(
        known.filter("n > 1").groupBy(*_digest(F.col("file"), "f")).agg(F.collect_list(F.struct("name", "callers")).alias("asks")).withColumn("no", F.monotonically_increasing_id())
    )
    scoped = (
        open_calls.select("no", "asks").join(cut(_imported_names(open_calls, by_file, imports)), "no")
        .select(F.explode("asks").alias("ask"), "found")
        .select("ask.callers", F.element_at("found", F.col("ask.name")).alias("dst"))
    )
    return (
        unique.unionByName(same_file)
        .unionByName(scoped)
        .filter(F.col("dst").isNotNull())
        .select(F.explode("callers").alias("src"), "dst")
        .filter(F.col("src") != F.col("dst"))
        .distinct()
    )


def _imported_names(open_calls: DataFrame, by_file: DataFrame, imports: DataFrame) -> DataFrame:
    """(no, found): for a file that imports others, the earliest function of each name in these, as a map.

    A row per import carries the buckets of all names that its file looks for, so imports and names are not
    multiplied into rows. The imported file has one row, with its functions; those in buckets that both
    have are candidates, among which the caller's file picks by the name itself.
    """
    wanted = open_calls.select("f1", "f2", "no", F.array_distinct(F.transform("asks", lambda a: _bucket(a["name"]))).alias("wanted"))
    # Dealt out by file at once, so neither the distinct nor the join moves the rows again.
    links = (
        imports.filter(F.col("resolved").isNotNull())
        .select(*_digest(F.col("file"), "f"), *_digest(F.col("resolved"), "r"))
        .repartition("f1", "f2")
        .distinct()
    )
    offered = (
        by_file.select(*_digest(F.col("file"), "r"), F.struct(_bucket(F.col("name")).alias("bucket"), "name", "id", "ord").alias("def"))
        .groupBy("r1", "r2")
        .agg(F.collect_list("def").alias("defs"))
        .withColumn("has", F.array_distinct("defs.bucket"))
    )
    met = links.join(wanted, ["f1", "f2"]).select("r1", "r2", "no", "wanted").join(offered, ["r1", "r2"]).filter(F.arrays_overlap("wanted", "has"))
    hits = F.filter("defs", lambda d: F.array_contains("wanted", d["bucket"]))
    return (
        met.select("no", F.explode(hits).alias("d"))
        .select("no", "d.name", F.struct("d.ord", "d.id").alias("def"))
        .repartition("no")
        .groupBy("no", "name")
        .agg(F.min("def").alias("def"))
        .groupBy("no")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "def.id"))).alias("found"))
    )
