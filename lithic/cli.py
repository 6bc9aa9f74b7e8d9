"""Command line: analyse a source tree and store its catalog."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from lithic.functions.text import repo_id
from lithic.plans.analyze import Analysis
from lithic.session import build_session
from lithic.sources.store import Store


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="lithic", description="Analyse a source tree and write one table per relation.")
    ap.add_argument("source", help="folder with the checked-out tree")
    ap.add_argument("--ref", default="", help="version label, part of the catalog id")
    ap.add_argument("--out", default="catalog", help="folder of the catalog")
    args = ap.parse_args(argv)
    spark = build_session()
    rid = spark.range(1).select(repo_id(F.lit(args.source), F.lit(args.ref))).first()[0]
    store = Store(spark, args.out, rid)
    relations = Analysis.of_tree(spark, args.source).relations()
    store.save_all(relations)
    counts = {r["relation"]: r["rows"] for r in store.summary(sorted(relations)).collect()}
    json.dump({"id": rid, "counts": counts}, sys.stdout, indent=2)
    print()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
