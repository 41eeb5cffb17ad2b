"""python -m repoweave analyze ROOT OUT [--snapshot S] | plan OUT PREVIOUS CURRENT; results and failures are JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .plans import analyze, update
from .session import session


def _components(spark, folder: str, snapshot: str):
    read = lambda name: spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/snapshot={snapshot}")
    edges = read("edges").groupBy(F.col("caller").alias("id")).agg(F.sort_array(F.collect_set("callee")).alias("depends_on"))
    return update.prepared(read("components").join(edges, "id", "left"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="repoweave")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze")
    a.add_argument("root")
    a.add_argument("out")
    a.add_argument("--snapshot", default="1")
    a.add_argument("--include", action="append", default=[])
    a.add_argument("--exclude", action="append", default=[])
    a.add_argument("--focus", action="append", default=[])
    p = commands.add_parser("plan")
    for name in ("out", "previous", "current"):
        p.add_argument(name)
    args = parser.parse_args(argv)
    spark = session(spark__sql__shuffle__partitions="8")
    try:
        if args.command == "analyze":
            tables = analyze.analyze(spark, args.root, args.include, args.exclude, args.focus)
            analyze.written(tables, args.out, args.snapshot)
            print(json.dumps({"ok": True, "counts": {n: spark.read.parquet(f"{args.out}/{n}").where(F.col("snapshot") == args.snapshot).count() for n in tables}}))
        else:
            plan = update.plan(_components(spark, args.out, args.previous), _components(spark, args.out, args.current))
            print(json.dumps({"ok": True, **plan["outcome"].first().asDict(), "changes": {r["kind"]: r["count"] for r in plan["changes"].groupBy("kind").count().collect()}}))
    except Exception as e:  # the contract: failures are JSON too
        print(json.dumps({"ok": False, "error": str(e).split("\n")[0]}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
