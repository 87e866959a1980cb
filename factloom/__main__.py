"""python -m factloom COMMAND: run, benchmark, golden and profile over a folder of words."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import layout, report
from .plans.pipeline import run_all
from .sources.readers import named, read_golden, read_words
from .sources.writers import default_output, write_workbooks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("run", "write the sheets of all documents"), ("benchmark", "count verdicts by document, with totals"), ("golden", "grade values against known ones"), ("profile", "sizes and text quality of all pages")):
        sub = commands.add_parser(name, help=about)
        sub.add_argument("words", help="folder of words with coordinates")
        if name == "run":
            sub.add_argument("out", nargs="?", help="folder of the sheets; output/<name>_metrics by default")
            sub.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
        if name == "golden":
            sub.add_argument("golden", help="JSON object of documents")
            sub.add_argument("filter", nargs="?", default="", help="part of the documents' names")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    words, start = read_words(spark, args.words), time.time()
    if args.command == "profile":
        report.page_profile(layout.page_scan(words)).orderBy("doc").show(1000, False)
        return
    known = named(read_golden(spark, args.golden), args.filter) if args.command == "golden" else None
    made = run_all(words if known is None else words.join(known.select("doc").distinct(), "doc", "left_semi"))
    if args.command == "run":
        out = args.out or default_output(args.words)
        write_workbooks(made, out, args.format)
        print(f"written to {out}")
    elif args.command == "benchmark":
        report.scorecard(report.primary(made.verdicts)).orderBy(F.col("doc").isNull(), "doc").show(1000, False)
    else:
        grades = report.graded(known, report.primary(made.verdicts)).persist()
        report.golden_scorecard(grades).orderBy(F.col("doc").isNull(), "doc").show(1000, False)
        grades.where("status = 'VERIFIED' AND grade <> 'CORRECT'").show(1000, False)
        grades.unpersist()
    made.close()
    print(f"{time.time() - start:.1f} s")


if __name__ == "__main__":
    main()
