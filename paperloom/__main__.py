"""Command line: ``python -m paperloom COMMAND``; every command prints JSON lines or writes tables."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperloom")
    c = p.add_subparsers(dest="command", required=True)
    ingest = c.add_parser("ingest", help="take in new articles of a folder")
    ingest.add_argument("folder")
    ingest.add_argument("out")
    ingest.add_argument("--model-version", default="1")
    ingest.add_argument("--size", type=int, default=180)
    ingest.add_argument("--overlap", type=int, default=30)
    status = c.add_parser("status", help="the last status of each file")
    status.add_argument("out")
    parse = c.add_parser("parse", help="articles of a folder as JSON")
    parse.add_argument("folder")
    parse.add_argument("out")
    c.add_parser("queries", help="the names of all queries")
    run = c.add_parser("run", help="one query over a data directory")
    run.add_argument("name")
    run.add_argument("data")
    run.add_argument("--limit", type=int, default=20, help="rows printed")
    run.add_argument("--out", help="write all rows there as Parquet instead")
    search = c.add_parser("search", help="the ten fused passages of a data directory")
    search.add_argument("data")
    bundle = c.add_parser("bundle", help="the search bundle of a data directory")
    bundle.add_argument("data")
    for name, text in (("quality", "quality by status"), ("misses", "the most frequent misses")):
        c.add_parser(name, help=text).add_argument("data")
    return p


def show(df: DataFrame, most: int) -> None:
    for line in df.limit(most).toJSON().collect():
        print(line)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    from paperloom.plans import registry

    queries = registry.queries()
    if args.command == "queries":
        print("\n".join(queries))
        return 0
    if args.command == "run" and args.name not in queries:
        print(f"no query {args.name}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    if args.command == "ingest":
        from paperloom.streaming.ingest import ingest

        ingest(spark, args.folder, args.out, args.model_version, args.size, args.overlap)
    elif args.command == "status":
        from paperloom.streaming.ingest import status

        show(status(spark, args.out), 500)
    elif args.command == "parse":
        from paperloom.sources import articles

        articles.write_json(articles.read_articles(spark, args.folder), args.out)
    elif args.command == "run":
        df = queries[args.name](spark, args.data)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            show(df, args.limit)
    elif args.command == "search":
        show(queries["hybrid_retrieval"](spark, args.data), 50)
    elif args.command == "bundle":
        from paperloom.operators.search import bundle

        parts = {"text_hits": "bundle_passages", "table_hits": "table_search", "figure_hits": "figure_search", "papers": "bundle_papers", "entities": "bundle_entities", "citations": "bundle_citations", "stats": "bundle_stats"}
        print(json.dumps(bundle("", {k: queries[q](spark, args.data) for k, q in parts.items()}), default=str))
    else:
        show(queries[{"quality": "quality_report", "misses": "miss_report"}[args.command]](spark, args.data), 500)
    return 0


if __name__ == "__main__":
    sys.exit(main())
