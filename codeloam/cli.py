"""scan, diff and trend on the command line: python -m codeloam.cli."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .plans import compare, scan
from .report.render import FORMATS, render


def session() -> SparkSession:
    spark = SparkSession.builder.appName("codeloam").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="codeloam")
    commands = parser.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--format", default="text", help=f"one of {', '.join(FORMATS)}")
    shared.add_argument("--no-cache", action="store_true")
    one = commands.add_parser("scan", parents=[shared])
    one.add_argument("target", nargs="?", default="HEAD", help="a directory, or else a revision")
    two = commands.add_parser("diff", parents=[shared])
    two.add_argument("--base", required=True)
    two.add_argument("--head", required=True)
    two.add_argument("--trend", type=int, default=0, help="months of history below the report")
    many = commands.add_parser("trend", parents=[shared])
    how = many.add_mutually_exclusive_group(required=True)
    how.add_argument("--merges", type=int)
    how.add_argument("--months", type=int)
    return parser.parse_args(argv)


def run(argv: list[str], spark: SparkSession | None = None, repository: str = ".") -> str:
    a = arguments(argv)
    if a.format not in FORMATS:
        raise ValueError(f'format must be md, json, or text, got "{a.format}"')
    spark = spark or session()
    cache = None if a.no_cache else os.environ.get("CODELOAM_CACHE")
    if a.command == "scan":
        if os.path.isdir(os.path.join(repository, a.target)):
            return render("snapshot", compare.snapshot_document(scan.scan_directory(spark, os.path.join(repository, a.target)), "directory"), a.format)
        tree = scan.G.resolve_tree(repository, a.target)
        return render("snapshot", compare.snapshot_document(scan.scan_revisions(spark, repository, {a.target: tree}, cache), tree), a.format)
    if a.command == "diff":
        doc = compare.diff_revisions(spark, repository, a.base, a.head, cache)
        if a.trend:
            doc["trend"] = compare.trend_points(spark, repository, a.head, months=a.trend, cache=cache)
        return render("diff", doc, a.format, color=a.format == "text" and sys.stdout.isatty())
    return render("trend", compare.trend_points(spark, repository, "HEAD", a.months, a.merges, cache), a.format)


def main() -> int:
    try:
        sys.stdout.write(run(sys.argv[1:]))
    except Exception as error:
        print(f"codeloam: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
