"""The catalog on disk: one Parquet table per relation, a JSON history, and a memo table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

HISTORY_SCHEMA = "at string, event string, detail string"
MEMO_SCHEMA = "key string, repo string, text string"
HISTORY_SHOWN = 60


class Store:
    """Relations of one repository under `<root>/repo_id=<id>/`."""

    def __init__(self, spark: SparkSession, root: str, repo: str):
        self.spark, self.repo = spark, repo
        self.base = f"{root.rstrip('/')}/repo_id={repo}"

    def _path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def exists(self, name: str) -> bool:
        try:
            self.spark.read.parquet(self._path(name)).schema
            return True
        except AnalysisException:
            return False

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(name))

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def ensure(self, name: str, build) -> DataFrame:
        """Compute and store a relation only when it is missing."""
        if not self.exists(name):
            self.save(name, build())
        return self.load(name)

    def save_all(self, relations: dict[str, DataFrame]) -> None:
        """Store every relation; one that fails while it is computed is logged and left out."""
        saved = []
        for name, df in relations.items():
            try:
                self.save(name, df)
                saved.append(name)
            except Exception as e:  # one relation must not stop the others
                self.log("failed", {"relation": name, "error": str(e).splitlines()[0]})
        self.log("index", {"relations": sorted(saved)})

    # history: append-only
    def log(self, event: str, detail: dict) -> None:
        row = self.spark.range(1).select(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("at"), F.lit(event).alias("event"), F.lit(json.dumps(detail)).alias("detail")
        )
        row.write.mode("append").json(self._path("history"))

    def history(self, limit: int = HISTORY_SHOWN) -> DataFrame:
        try:
            return self.spark.read.schema(HISTORY_SCHEMA).json(self._path("history")).orderBy(F.desc("at")).limit(limit)
        except AnalysisException:
            return self.spark.createDataFrame([], HISTORY_SCHEMA)

    def history_count(self) -> int:
        return self.history(1 << 30).count()

    # memo: explanations by content key
    def memo(self) -> DataFrame:
        return self.load("memo") if self.exists("memo") else self.spark.createDataFrame([], MEMO_SCHEMA)

    def memo_put(self, entries: DataFrame) -> None:
        """Append (parts array<string>, text); the key is a SHA-1 prefix of repository and parts."""
        rows = entries.select(memo_key(F.lit(self.repo), F.col("parts")).alias("key"), F.lit(self.repo).alias("repo"), "text")
        rows.join(self.memo().select("key"), "key", "left_anti").select("key", "repo", "text").write.mode("append").parquet(self._path("memo"))

    def memo_get(self, parts: list[str]) -> str | None:
        row = self.memo().filter(F.col("key") == memo_key(F.lit(self.repo), F.array(*[F.lit(p) for p in parts]))).select("text").first()
        return row["text"] if row else None

    def memo_list(self) -> DataFrame:
        return self.memo().select("key", F.length("text").alias("bytes"))

    def memo_clear(self) -> int:
        n = self.memo().count()
        self.save("memo", self.spark.createDataFrame([], MEMO_SCHEMA))
        self.log("clear-memory", {"cleared": n})
        return n

    def summary(self, names: list[str]) -> DataFrame:
        """(relation, rows) of the stored relations plus history and memo."""
        out = None
        for n in names:
            if self.exists(n):
                part = self.load(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("relation"), "rows")
                out = part if out is None else out.unionByName(part)
        extra = self.spark.createDataFrame([("history", self.history_count()), ("memo", self.memo().count())], "relation string, rows bigint")
        return extra if out is None else out.unionByName(extra)


def memo_key(repo, parts):
    return F.substring(F.sha1(F.concat_ws("|", repo, F.array_join(parts, "|"))), 1, 16)
