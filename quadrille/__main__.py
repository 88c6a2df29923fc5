"""Commands over files: query a graph, validate a dataset or benchmark, evaluate predictions, write a report."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import engine
from .operators import catalogue, evaluation, release
from .sources import jsonl, turtle


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quadrille", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *files: str, **options: str) -> None:
        made = commands.add_parser(name)
        for f in files:
            made.add_argument(f)
        for o, text in options.items():
            made.add_argument(f"--{o}", help=text)

    command("query", "graph", "text")
    command("validate", "graph", "catalogue", "folder")
    command("benchmark", "graph", "catalogue", "test", train="rows that questions must not come from")
    command("evaluate", "graph", "test", predictions="file of id and prediction; the references themselves without it")
    command("report", "graph", "catalogue", "folder", out="file to write")
    return parser


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("quadrille").getOrCreate()
    graph = turtle.load_graph(spark, a.graph)
    if a.command == "query":
        print(engine.render_rows(engine.execute_select(graph, a.text)))
        return 0
    try:
        if a.command == "evaluate":
            examples = jsonl.load_benchmark(spark, a.test)
            predictions = jsonl.load_predictions(spark, a.predictions) if a.predictions else evaluation.reference_predictions(examples)
            cases, differences = evaluation.evaluate_benchmark(examples, predictions, graph)
            rates = {r["scope"]: {k: v for k, v in r.asDict().items() if k != "scope"} for r in evaluation.scope_rates(cases).collect()}
            print(json.dumps({"scopes": rates, "differences": differences.groupBy("problem").count().collect()}, ensure_ascii=False, default=str))
            return 0
        families = catalogue.load_catalogue(spark, a.catalogue)
        if a.command == "benchmark":
            train = jsonl.load_dataset(spark, a.train) if a.train else None
            found = release.validate_benchmark(jsonl.load_benchmark(spark, a.test), families, graph, train)
        else:
            rows = jsonl.load_release(spark, a.folder)
            if a.command == "report":
                version = jsonl.committed(spark, a.folder)
                files = jsonl.file_digests(spark, f"{a.folder}/*.jsonl" if version is None else f"{version}/*.jsonl/part-*")
                made = release.dataset_report(rows, families, graph, files)
                text = json.dumps(made, ensure_ascii=False, indent=2, default=str) + "\n"
                print(text) if a.out is None else jsonl.write_text(spark, text, a.out)
                return 0
            found = release.validate_release(rows, families, graph)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    for r in found.orderBy(*[F.col(c) for c in found.columns if c != "n"]).collect():
        print(*r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
