"""The command line: build, query and serve databases."""

from __future__ import annotations

import argparse
import sys
from time import perf_counter

from pyspark.sql import SparkSession

from brindle.engine import Engine
from brindle.plans.compile import compile_query
from brindle.plans.syntax import parse


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="brindle", description="Graph patterns on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("build", "build a database from a file of triples"), ("query", "run the queries of a file, one on a line"), ("server", "serve databases over HTTP")):
        command = commands.add_parser(name, help=text)
        command.add_argument("--db", "--database", "--name", dest="db", required=name != "server", help="the database's name")
        command.add_argument("--root", default="databases", help="the folder that holds all databases")
        if name != "server":
            command.add_argument("-f", "--file", required=True, help="the file to read")
        else:
            command.add_argument("--ip", default="127.0.0.1")
            command.add_argument("-p", "--port", required=True, type=int)
    return parser


def run_queries(engine: Engine, name: str, lines: list[str], out=sys.stdout) -> None:
    """Print the rows of each query, its number of rows and its times in milliseconds. Blank lines are skipped."""
    texts = [line.strip() for line in lines if line.strip()]
    for k, text in enumerate(texts, 1):
        if len(texts) > 1:
            print(f"[{k}] {text}", file=out)
        began = perf_counter()
        frame = compile_query(engine.graph(name), parse(text))
        planned = perf_counter()
        rows, shown = 0, 0.0
        for row in frame.toLocalIterator():
            at = perf_counter()
            print(" ".join("" if x is None else str(x) for x in row), file=out)
            rows, shown = rows + 1, shown + perf_counter() - at
        ended = perf_counter()
        print(f"rows: {rows}", file=out)
        for what, seconds in (("plan", planned - began), ("execution", ended - planned - shown), ("output", shown), ("total", ended - began)):
            print(f"{what}: {seconds * 1e3:.3f} ms", file=out)


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("brindle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.root)
    try:
        if args.command == "build":
            began = perf_counter()
            engine.create(args.db, args.file)
            print(f"{args.db} was built in {(perf_counter() - began) * 1e3:.3f} ms")
        elif args.command == "query":
            with open(args.file, encoding="utf-8") as file:
                run_queries(engine, args.db, file.readlines())
        else:
            engine.serve(args.ip, args.port, args.db)
    except ValueError as error:
        print(f"brindle: {error}", file=sys.stderr)
        return 1
    return 0
