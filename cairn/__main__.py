"""python -m cairn build --config FILE: builds the index that a JSON config declares from its JSON-lines or Parquet input; search, report and verify read it."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairn", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build_command = commands.add_parser("build", help="build or resume an index")
    build_command.add_argument("--config", required=True)
    build_command.add_argument("--checksums", action="store_true", help="record a checksum of every table")
    for name, text in (("report", "print what the build cost and what the index holds"), ("verify", "compare every table with its checksum")):
        command = commands.add_parser(name, help=text)
        command.add_argument("--index", required=True)
    search_command = commands.add_parser("search", help="build or resume an index and print one page of results")
    search_command.add_argument("--config", required=True)
    search_command.add_argument("query", nargs="?", default="")
    search_command.add_argument("--size", type=int, default=10)
    search_command.add_argument("--trace", action="store_true", help="print milliseconds by span")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from cairn.operators.index import build, open_index
    from cairn.operators.search import search
    from cairn.plans.config import IndexConfig
    from cairn.sources.readers import read_json_lines, with_ordinals
    from cairn.sources.store import read_json

    spark = SparkSession.builder.appName("cairn").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "report":
        print(json.dumps({name: read_json(spark, f"{args.index}/{name}.json") for name in ("telemetry", "optimizer")}))
        return 0
    if args.command == "verify":
        print(json.dumps({"verified": sorted(open_index(spark, args.index, verify=True).tables)}))
        return 0
    cfg, source, target = IndexConfig.from_json(args.config)
    if source.endswith(".parquet"):
        docs = spark.read.parquet(source)
        docs = docs if "doc" in docs.columns else with_ordinals(docs, "doc", [cfg.id_path])
    else:
        docs = read_json_lines(spark, source)
    index = build(docs, cfg, target or None, source, checksums=getattr(args, "checksums", False))
    if args.command == "build":
        print(json.dumps({"total": index.n, "path": index.path, "reused": index.reused}))
    else:
        result = search(index, args.query, size=args.size, trace=args.trace)
        print(json.dumps({"total": result.total, "corrected_query": result.corrected_query, "stats": result.stats, "results": [r.asDict() for r in result.rows.collect()]}, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
