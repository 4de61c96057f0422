"""The command line: analyse a folder into a stored graph, and ask it.

    python -m graphloom analyze FOLDER --out GRAPH
    python -m graphloom impact TARGET --graph GRAPH --direction downstream --depth 2
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .codegraph import CodeGraph
from .server import Workbench, answer, plain, serve


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, graph: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        if graph:
            p.add_argument("--graph", required=True)
        return p

    add("analyze", "folder", graph=False).add_argument("--out", required=True)
    add("status")
    add("query", "words").add_argument("--limit", type=int, default=5)
    add("context", "name").add_argument("--file", default="")
    p = add("impact", "target")
    p.add_argument("--direction", default="upstream")
    p.add_argument("--depth", type=int, default=3)
    p.add_argument("--min-confidence", type=float, default=0.0)
    p.add_argument("--include-tests", action="store_true")
    add("cypher", "query")
    add("grep", "pattern").add_argument("--limit", type=int, default=50)
    add("detect-changes", "diff")
    add("mcp")
    add("serve").add_argument("--port", type=int, default=4747)
    return top


def run(spark: SparkSession, args: argparse.Namespace):
    if args.command == "analyze":
        folder = args.folder if "://" in args.folder else f"file://{args.folder}"
        g = CodeGraph.of_folder(spark, folder)
        skipped = g.save(args.out)
        return json.loads(g.stats()) | {"skipped": skipped}
    g = CodeGraph.load(spark, args.graph)
    if args.command == "status":
        return json.loads(g.stats())
    if args.command == "query":
        return plain(g.query(args.words, args.limit))
    if args.command == "context":
        return plain(g.context(args.name, file_path=args.file))
    if args.command == "impact":
        return plain(g.impact(args.target, direction=args.direction, max_depth=args.depth, min_confidence=args.min_confidence, include_tests=args.include_tests))
    if args.command == "cypher":
        return plain(g.cypher(args.query))
    if args.command == "grep":
        return plain(g.grep(args.pattern, args.limit))
    if args.command == "detect-changes":
        with (sys.stdin if args.diff == "-" else open(args.diff, encoding="utf-8")) as f:
            return plain(g.detect_changes(f.read()))
    bench = Workbench(spark)
    bench.register("graph", args.graph, g)
    if args.command == "serve":
        serve(bench, port=args.port).serve_forever()
    for line in sys.stdin:
        reply = answer(bench, json.loads(line))
        if reply is not None:
            print(json.dumps(reply), flush=True)
    return None


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    out = run(spark, args)
    if out is not None:
        print(json.dumps(out, indent=2, default=str))


if __name__ == "__main__":
    main()
