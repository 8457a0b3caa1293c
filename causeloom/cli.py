"""``python -m causeloom.cli``: analyse a text, ask a graph, export one.

    analyze --text T --lexicon L.json [--language fr]   the text's graph, as JSON
    query "WHY x" --graph G.json                        the answer's rows, as JSON lines
    export --graph G.json --to dot|json                 the graph's lines

A graph is always processed (cycles, gaps, validation) before it is asked or exported; what
validation finds goes to standard error.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import export, frontend, middle
from .plans import language
from .plans.graph import NodeNotFound, NoPath, TooLarge


def _processed(spark: SparkSession, path: str):
    graph, _, found = middle.process(export.load(spark, path))
    for r in found.collect():  # of one graph of a bounded file
        print(f"{r.severity}: {r.kind} {r.subject}", file=sys.stderr)
    return graph


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="causeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze")
    analyze.add_argument("--text", required=True)
    analyze.add_argument("--lexicon", required=True, help="JSON list of [kind, words, relation, direction]")
    analyze.add_argument("--language", default="fr", choices=("fr", "en"))
    query = commands.add_parser("query")
    query.add_argument("question")
    query.add_argument("--graph", required=True)
    to = commands.add_parser("export")
    to.add_argument("--graph", required=True)
    to.add_argument("--to", default="json", choices=("json", "dot"))
    args = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("causeloom").getOrCreate()
    try:
        if args.command == "analyze":
            with open(args.lexicon, encoding="utf-8") as file:
                lexicon = [tuple(x) for x in json.load(file)]
            docs = spark.createDataFrame([(0, args.text)], "doc_id long, text string")
            found = frontend.clauses(docs, lexicon, args.language)
            state = frontend.status(docs, found).head().status
            if state != "parsed":
                print(f"error: {state} text", file=sys.stderr)
                return 2
            print(export.as_document(frontend.graph_of(found, args.language)).head().json)
        elif args.command == "query":
            for row in language.run(_processed(spark, args.graph), args.question).toJSON().toLocalIterator():
                print(row)
        else:
            graph = _processed(spark, args.graph)
            rows = export.to_dot(graph) if args.to == "dot" else export.as_document(graph).selectExpr("json AS line")
            for row in rows.toLocalIterator():
                print(row.line)
    except (NodeNotFound, NoPath, TooLarge, language.QueryParseError) as e:
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
