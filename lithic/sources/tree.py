"""Scan of a source tree: filter by path and size before any content is read, classify, decode."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions.languages import DATA_LANGUAGES, EXT_TO_LANG, META_FILES, META_PATTERNS
from lithic.functions.text import base_name, extension

MAX_FILE_BYTES = 2 * 1024 * 1024
# Folders and files that are never read.
IGNORED_DIRS = """.git .hg .svn node_modules bower_components vendor dist build out .next .nuxt .svelte-kit target bin obj __pycache__ .venv venv env
.tox .mypy_cache .pytest_cache coverage .cache .gradle .idea .vscode Pods .dart_tool .terraform deps _build .parcel-cache site-packages .expo
DerivedData .cargo""".split()
IGNORED_FILES = (
    r"(?i)\.min\.(js|css)$|\.map$|\.lock$|-lock\.(json|yaml)$|\.(png|jpe?g|gif|svg|ico|webp|bmp|tiff|pdf|zip|gz|tar|rar|7z|mp4|mp3|wav|mov|avi|woff2?|ttf"
    r"|eot|otf|bin|exe|dll|so|dylib|class|o|a|wasm|pyc|jar|war)$"
)


def language_of(path: Column) -> Column:
    """Language id by extension, or null. Container build files have none."""
    table = F.create_map(*[F.lit(x) for kv in EXT_TO_LANG.items() for x in kv])
    base = F.lower(base_name(path))
    return F.when(base.rlike(r"^dockerfile(\.|$)"), F.lit(None)).otherwise(F.element_at(table, extension(F.lower(path))))


def meta_of(path: Column) -> Column:
    base = base_name(path)
    out = F.element_at(F.create_map(*[F.lit(x) for kv in META_FILES.items() for x in kv]), base)
    for rx, name in META_PATTERNS:
        out = F.coalesce(out, F.when(base.rlike(rx), F.lit(name)))
    return out


def is_ignored_dir(path: Column) -> Column:
    names = "|".join(d.replace(".", r"\.") for d in IGNORED_DIRS)
    return path.rlike(rf"(^|/)({names})/")


def classify(files: DataFrame) -> DataFrame:
    """Add lang, meta and ext to rows with a path."""
    p = F.col("path")
    return files.withColumn("lang", language_of(p)).withColumn("meta", meta_of(p)).withColumn("ext", extension(p))


def _below(path: Column, root: str) -> Column:
    """The part of a path after the root folder; null where the root is not part of it."""
    return F.get(F.split(path, re.escape(root.rstrip("/") + "/"), 2), F.lit(1))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file under the root, relative to it; the content column is pruned."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(_below(F.col("path"), root).alias("path"), F.col("length").alias("size"))


def skip_counts(files: DataFrame) -> DataFrame:
    """One row: files left out as binary, too big, or inside an ignored folder."""
    p, ignored = F.col("path"), is_ignored_dir(F.col("path"))
    binary = ~ignored & base_name(p).rlike(IGNORED_FILES)
    return files.agg(
        F.count_if(binary).alias("binary"),
        F.count_if(~ignored & ~base_name(p).rlike(IGNORED_FILES) & (F.col("size") > MAX_FILE_BYTES)).alias("too_big"),
        F.count_if(ignored).alias("ignored_dir"),
    )


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, lang, meta, ext, content, text) of the readable text files.

    Conditions on `_metadata` are evaluated on the file listing, so files in ignored folders, files of ignored kinds
    and files above the size limit are never opened. Bytes that are not UTF-8 are replaced; files with a NUL byte are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = F.col("_metadata.file_path")
    inside = F.coalesce(_below(listed, quote(root, safe="/:+@!$&'()*,;=~")), base_name(listed))  # listed paths are percent-encoded
    kept = raw.filter(F.col("_metadata.file_size") <= MAX_FILE_BYTES).filter(~base_name(listed).rlike(IGNORED_FILES)).filter(~is_ignored_dir(inside))
    files = kept.withColumn("path", _below(F.col("path"), root)).filter(~is_ignored_dir(F.col("path")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    files = files.filter(~F.contains("content", F.lit(b"\x00")))
    return classify(files.select("path", F.col("length").alias("size"), "content", text.alias("text")))


def scannable(files: DataFrame) -> DataFrame:
    """Files the signal detectors look at: any known language, SQL and environment files."""
    return files.filter(F.col("lang").isNotNull() | (F.col("ext") == ".sql") | (F.col("meta") == "env"))


def code_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("lang").isNotNull() & ~F.col("lang").isin(list(DATA_LANGUAGES)))
