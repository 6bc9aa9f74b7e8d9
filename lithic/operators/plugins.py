"""Registry of table transforms that contribute nodes, edges, layers, insights and tags."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions.text import base_name
from lithic.session import cut

Catalog = dict[str, DataFrame]
# The shape of every contribution.
SHAPES = {
    "nodes": "id string, type string, label string, path string, layer string",
    "edges": "source string, target string, type string",
    "layers": "layer string, node string",
    "insights": "plugin string, insight string, label string, count bigint",
    "tags": "node string, tag string",
}


@dataclass
class Plugin:
    id: str
    label: str
    description: str
    applies_to: Callable[[Catalog], bool]
    contribute: Callable[[Catalog], dict[str, DataFrame]]


@dataclass
class Result:
    relations: dict[str, DataFrame]
    ran: list[dict] = field(default_factory=list)


def _nonempty(name: str) -> Callable[[Catalog], bool]:
    return lambda c: name in c and not c[name].isEmpty()


def _infra(c: Catalog) -> dict[str, DataFrame]:
    infra = c["infra"].withColumn("id", F.concat_ws(":", F.lit("infra"), "system", "file"))
    nodes = infra.select("id", F.lit("infra").alias("type"), base_name(F.col("file")).alias("label"), F.col("file").alias("path"), F.lit("infrastructure").alias("layer"))
    edges = infra.join(c["files"].select(F.col("path").alias("file")), "file", "left_semi").select(
        F.concat(F.lit("file:"), "file").alias("source"), F.col("id").alias("target"), F.lit("configures").alias("type")
    )
    per_system = infra.groupBy("system").agg(F.count("*").alias("count"))
    return {
        "nodes": nodes,
        "edges": edges,
        "layers": nodes.select("layer", F.col("id").alias("node")),
        "insights": per_system.select(F.lit("infra").alias("plugin"), F.lit("infra-systems").alias("insight"), F.col("system").alias("label"), "count"),
    }


def _security(c: Catalog) -> dict[str, DataFrame]:
    sev = F.when(F.col("severity").isin("high", "medium"), F.col("severity")).otherwise("low")
    per = c["security"].groupBy(sev.alias("label")).agg(F.count("*").alias("count"))
    return {
        "tags": c["security"].select(F.concat(F.lit("file:"), "file").alias("node"), F.concat(F.lit("security:"), "type").alias("tag")).distinct(),
        "insights": per.select(F.lit("security").alias("plugin"), F.lit("security-findings").alias("insight"), "label", "count"),
    }


def _deps(c: Catalog) -> dict[str, DataFrame]:
    per = c["dependencies"].groupBy(F.col("ecosystem").alias("label")).agg(F.count("*").alias("count"))
    return {"insights": per.select(F.lit("deps").alias("plugin"), F.lit("dep-ecosystems").alias("insight"), "label", "count")}


BUILT_IN = [
    Plugin("infra", "Infrastructure", "Container, pipeline and deploy files as nodes.", _nonempty("infra"), _infra),
    Plugin("security", "Security", "Findings as node tags and a severity insight.", _nonempty("security"), _security),
    Plugin("deps", "External dependencies", "Ecosystems of declared dependencies.", _nonempty("dependencies"), _deps),
]


class Registry:
    def __init__(self, plugins: list[Plugin] | None = None):
        self.plugins = list(BUILT_IN if plugins is None else plugins)

    def register(self, plugin: Plugin) -> None:
        self.plugins.append(plugin)

    def describe(self) -> list[dict]:
        return [{"id": p.id, "label": p.label, "description": p.description} for p in self.plugins]

    def run(self, spark, catalog: Catalog) -> Result:
        """Merge the contributions; a plugin that fails, while planning or while running, is recorded and skipped.

        Each contribution is written before it is merged, so a late failure cannot reach what others gave.
        """
        out = Result({name: spark.createDataFrame([], ddl) for name, ddl in SHAPES.items()})
        for p in self.plugins:
            try:
                if not p.applies_to(catalog):
                    continue
                given = {name: cut(df) for name, df in p.contribute(catalog).items()}
                for name, df in given.items():
                    out.relations[name] = out.relations[name].unionByName(df, allowMissingColumns=True)
                out.ran.append({"id": p.id, "label": p.label})
            except Exception as e:  # one plugin must not stop the others
                out.ran.append({"id": p.id, "error": str(e)})
        return out
