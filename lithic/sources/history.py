"""Readers of exported version history. Fetching a repository is left to the caller's tooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS, RECENT = 50, 30


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (commit, date, subject) lines."""
    return spark.read.csv(path, sep="\t", quote="", schema="commit string, date string, subject string").withColumn(
        "subject", F.substring("subject", 1, 80)
    )


def read_commit_paths(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (commit, path) lines."""
    return spark.read.csv(path, sep="\t", quote="", schema="commit string, path string")


def refs(branches: DataFrame, tags: DataFrame, commits: DataFrame) -> DataFrame:
    """(kind, name): all branches, the 50 newest tags, the 30 newest commits."""
    newest = lambda df, n: df.orderBy(F.desc("date"), "name").limit(n)
    return (
        branches.select(F.lit("branch").alias("kind"), "name")
        .unionByName(newest(tags, TAGS).select(F.lit("tag").alias("kind"), "name"))
        .unionByName(newest(commits.withColumnRenamed("commit", "name"), RECENT).select(F.lit("commit").alias("kind"), "name"))
    )


def repository_meta(commits: DataFrame) -> DataFrame:
    """One row: head commit, its subject and date, and the number of commits."""
    last = F.max(F.struct("date", "commit", "subject"))
    return commits.agg(last["commit"].alias("commit"), last["subject"].alias("last_subject"), last["date"].alias("last_date"), F.count("*").alias("commit_count"))
