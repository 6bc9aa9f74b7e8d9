"""Incremental re-analysis: batch diff against a stored snapshot, and a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators import symbols, versioning
from lithic.session import cut
from lithic.sources import tree
from lithic.sources.store import Store

SNAPSHOT = "hashes"
FILE_SCHEMA = "path string, size bigint, text string, at timestamp"


def _records(changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Function and file records of changed files only; unchanged texts are never parsed."""
    files = tree.classify(changed.select("path", "size", "text"))
    fns = symbols.functions(symbols.parse(tree.code_files(files)))
    return fns, symbols.file_records(files, fns)


def _replace(store: Store, name: str, key: str, gone: DataFrame, fresh: DataFrame) -> None:
    """Anti join away the rows of touched paths and add the new ones."""
    old = store.load(name).join(gone.select(F.col("path").alias(key)), key, "left_anti")
    store.save(name, cut(old.unionByName(fresh, allowMissingColumns=True)))


def reindex(store: Store, files: DataFrame) -> dict[str, int]:
    """Compare files (path, size, text, content) with the stored snapshot and update what changed."""
    now = cut(versioning.snapshot(files))
    before = store.load(SNAPSHOT) if store.exists(SNAPSHOT) else store.spark.createDataFrame([], now.schema)
    diff = cut(versioning.diff_snapshots(before, now))
    counts = versioning.diff_counts(diff).first().asDict()
    if counts["changed"] == 0 and counts["deleted"] == 0:
        return counts
    touched = diff.filter(F.col("status") != "unchanged").select("path")
    changed = files.join(diff.filter(F.col("status").isin("added", "modified")).select("path"), "path", "left_semi")
    fns, records = _records(changed)
    if store.exists("files"):
        fns, records = cut(fns), cut(records)
        _replace(store, "functions", "file", touched, fns)
        _replace(store, "files", "path", touched, records)
    else:
        store.save("functions", fns)
        store.save("files", records)
    store.save(SNAPSHOT, now)
    store.log("reindex", counts)
    return counts


def watch(spark: SparkSession, source: str, store: Store, checkpoint: str, lateness: str = "1 hour"):
    """Stream of (path, size, text, at) records, merged into the store by path; a null text means that the file is gone.

    The snapshot keeps the time of the version it holds, of deleted files too, so a version that arrives after a
    newer one changes nothing, in whatever batch it comes. Replays are harmless for the same reason.
    """
    stream = spark.readStream.schema(FILE_SCHEMA).parquet(source).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["path", "at"])

    def merge(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("size", "text", "at"), "at").alias("v")).select("path", "v.*")
        newest = newest.withColumn("hash", F.substring(F.sha1("text"), 1, 16))
        none = spark.createDataFrame([], "path string, hash string, at timestamp")
        known = none.unionByName(cut(store.load(SNAPSHOT)) if store.exists(SNAPSHOT) else none, allowMissingColumns=True).select("path", "hash", "at")
        before = known.select("path", F.col("hash").alias("old_hash"), F.col("at").alias("old_at"))
        newer = cut(newest.join(before, "path", "left").filter(F.col("old_at").isNull() | (F.col("at") > F.col("old_at"))))
        touched = cut(newer.filter(~F.col("hash").eqNullSafe(F.col("old_hash"))).select("path", "size", "text"))
        if not touched.isEmpty():
            fns, records = (cut(df) for df in _records(touched.filter("text is not null")))
            if store.exists("files"):
                _replace(store, "functions", "file", touched, fns)
                _replace(store, "files", "path", touched, records)
            else:
                store.save("functions", fns)
                store.save("files", records)
        kept = known.join(newer.select("path"), "path", "left_anti")
        store.save(SNAPSHOT, cut(kept.unionByName(newer.select("path", "hash", "at"))))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
