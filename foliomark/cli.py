"""Command line: analyze one document, compare two, check a batch, show table sizes.

    python -m foliomark.cli analyze paper.txt --source a.txt --history old.docx --output report
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.language import detect_language
from .operators import detectors, fusion
from .plans.session import get_session
from .sources.readers import read_documents
from .sources.sinks import write_json_reports


def load(spark: SparkSession, paths: list[str], role: str) -> DataFrame | None:
    """Documents of files or folders with ids of their own and a language."""
    found: DataFrame | None = None
    for path in paths or []:
        rows = read_documents(spark, path, role)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return None
    # numbers of the paths in order; only paths go through the one task of this window
    numbers = found.select("path").distinct().withColumn("doc_id", F.row_number().over(Window.orderBy("path")).cast("bigint"))
    return found.filter("text is not null").join(numbers, "path").select("doc_id", "path", "text", F.lit("author").alias("author_key"), detect_language(F.col("text")).alias("lang"))


def analyze(spark: SparkSession, submitted: list[str], sources: list[str] = (), history: list[str] = (), corpus: list[str] = (), classroom: list[str] = ()) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(findings, report, runs) of the submitted documents."""
    documents = load(spark, list(submitted), "submitted")
    if documents is None:
        raise ValueError("no submitted document")
    inputs = detectors.Inputs(documents, load(spark, list(sources), "source"), load(spark, list(history), "history"), load(spark, list(corpus), "corpus"), load(spark, list(classroom), "classroom"))
    findings, runs = detectors.run_all(inputs)
    findings = findings.withColumn("finding_id", F.substring(F.sha2(F.concat_ws(":", "finding_type", "title", F.col("doc_id").cast("string"), F.col("source_id").cast("string")), 256), 1, 12))
    pieces = findings.select("finding_id", F.explode("evidence"))
    return findings, fusion.fuse(findings, pieces), runs


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliomark", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("analyze")
    one.add_argument("submitted")
    for name in ("source", "history", "corpus", "classroom"):
        one.add_argument(f"--{name}", action="append", default=[])
    two = commands.add_parser("compare")
    two.add_argument("file_a")
    two.add_argument("file_b")
    many = commands.add_parser("batch")
    many.add_argument("folder")
    sizes = commands.add_parser("stats")
    sizes.add_argument("root")
    for sub in (one, two, many):
        sub.add_argument("--output", "-o")
        sub.add_argument("--quiet", "-q", action="store_true")
    args = parser.parse_args(argv)
    spark = get_session("foliomark-cli")
    if args.command == "stats":
        from .operators.store import Store

        store = Store(spark, args.root)
        for name in ("documents", "findings", "agent_runs"):
            df = store.read(name)
            print(f"{name}: {0 if df is None else df.count()}")
        return 0
    if args.command == "analyze":
        findings, report, runs = analyze(spark, [args.submitted], args.source, args.history, args.corpus, args.classroom)
    elif args.command == "compare":
        findings, report, runs = analyze(spark, [args.file_a], [args.file_b])
    else:
        findings, report, runs = analyze(spark, [args.folder], classroom=[args.folder])
    if not args.quiet:
        for row in fusion.summary(report).orderBy("doc_id").limit(100).collect():
            print(row["summary"])
        print(json.dumps(runs))
    if args.output:
        write_json_reports(report, args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
