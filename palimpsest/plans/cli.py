"""Command line: audit files, or list the detectors.

Exit codes: 0 nothing at or above the threshold, 2 a finding reaches it, 3 a detector or a
file failed, 1 the request itself is wrong or no file could be read.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from ..functions.exprs import SEVERITIES
from ..operators import report
from ..schema import VECTORS
from .engine import Engine, parse_only, unknown


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description="Find content that was meant to be gone.")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="audit a PDF file or a folder of them")
    scan.add_argument("path")
    scan.add_argument("--json", action="store_true", help="one JSON report a line")
    scan.add_argument("--only", help="comma list of detectors")
    scan.add_argument("--fail-on", default="high", choices=SEVERITIES)
    scan.add_argument("--no-color", action="store_true")
    scan.add_argument("--no-fail-on-error", action="store_true")
    scan.add_argument("--max-bytes", type=int, default=512 << 20)
    scan.add_argument("--seconds", type=float, default=60.0)
    scan.add_argument("--max-memory", type=int, metavar="MB", help="memory of a Python worker")
    scan.add_argument("--out", help="new folder for the reports, as files by stamp, and their counts; nothing is printed but these")
    scan.add_argument("--to", help="shared folder for extracted tables; if not given, the one in spark.checkpoint.dir, or, where Spark runs on this machine alone, a temporary one")
    sub.add_parser("list-vectors", help="names of the detectors")
    return p


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    out = out or sys.stdout
    a = parser().parse_args(argv)
    if a.command == "list-vectors":
        print("\n".join(VECTORS), file=out)
        return 0
    only = parse_only(a.only)
    if bad := unknown(only):
        print(f"unknown detectors: {', '.join(bad)}; there are {', '.join(VECTORS)}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from ..sources import files

    if spark is None:
        builder = SparkSession.builder.appName("palimpsest")
        spark = (builder.config("spark.executor.pyspark.memory", f"{a.max_memory}m") if a.max_memory else builder).getOrCreate()
    try:
        to = f"{a.to or files.work_folder(spark)}/palimpsest-{uuid.uuid4().hex}"
        tables = files.load(spark, a.path, f"{to}/rows", a.max_bytes, a.seconds, only)
        unread = {r.open_status for r in tables.docs.select("open_status").distinct().collect()}
    except Exception as e:  # an unreadable path, in whatever way the store says so
        print(f"cannot read {a.path}: {type(e).__name__}", file=sys.stderr)
        return 1
    if "ok" not in unread:
        print(f"no readable file at {a.path}: {', '.join(sorted(unread)) or 'nothing there'}", file=sys.stderr)
        return 1
    reports = Engine().reports(tables, only, a.fail_on, not a.no_fail_on_error, f"{to}/findings")
    if a.out:
        counts = report.written_reports(reports, a.out, not a.json, not a.no_color)
        print(f"{counts['documents']} documents, {counts['findings']} findings: {a.out}/reports", file=out)
        return report.exit_code(counts)
    lines = report.as_json(reports, ("exit_code",)) if a.json else report.as_text(reports, not a.no_color, ("exit_code",))
    codes = set()
    try:
        for row in lines.orderBy("doc_id").toLocalIterator():
            codes.add(row.exit_code)
            print(row[1], file=out)
    except BrokenPipeError:
        return 0
    return 2 if 2 in codes else 3 if 3 in codes else 0
