"""Command line: lint files, show help or the version, or validate the installation."""

from __future__ import annotations

import argparse
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import lint, report
from .plans.validate import results_file, run_checks
from .sources import config as settings
from .sources.files import read_files

VERSION = "0.1.0"


class Output:
    """Lines for the console and a log file; silence mutes the console alone. An error makes the exit code 1."""

    def __init__(self, log: str | None = None, silent: bool = False):
        self.log = open(log, "w", encoding="utf-8") if log else None
        self.silent, self.exit_code = silent, 0

    def line(self, text: str = "", error: bool = False) -> None:
        if not self.silent:
            print(text, file=sys.stderr if error else sys.stdout)
        if self.log:
            self.log.write(f"{text}\n")

    def error(self, text: str) -> None:
        self.line(text, error=True)
        self.fail()

    def fail(self) -> None:
        self.exit_code = 1

    def close(self) -> None:
        if self.log:
            self.log.close()


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise ValueError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="quillframe", description="Check prose against controlled-English rules.", add_help=False, allow_abbrev=False)
    p.add_argument("globs", nargs="*", help="paths to check; they replace the include and exclude lists")
    p.add_argument("-v", "--version", action="store_true", help="show the version")
    p.add_argument("-?", "-h", "--help", action="store_true", help="show this help")
    p.add_argument("--validate", action="store_true", help="run the self-checks")
    p.add_argument("--results", "--result", metavar="FILE", help="write self-check results (.trx or .xml)")
    p.add_argument("--depth", type=int, choices=range(1, 7), default=1, help="heading depth of the self-check report")
    p.add_argument("--config", metavar="FILE", help="settings file")
    p.add_argument("--format", choices=("text", "json"), default="text", help="report format")
    p.add_argument("--strict", action="store_true", help="fail on warnings too")
    p.add_argument("--silent", action="store_true", help="write nothing to the console")
    p.add_argument("--log", metavar="FILE", help="write the output to a file as well")
    p.add_argument("--root", default=".", help="folder that paths are relative to")
    return p


def session() -> SparkSession:
    return SparkSession.builder.appName("quillframe").getOrCreate()


def run_lint(spark: SparkSession, args: argparse.Namespace, out: Output) -> None:
    config = settings.load(settings.resolve_path(args.config, args.root))
    docs = read_files(spark, args.root, config, args.globs or None).cache()
    found = lint.findings(docs, config).cache()
    total = report.counts(found).first()
    if args.format == "json":
        for line in report.json_lines(row["report"] for row in report.json_rows(docs, found).toLocalIterator()):
            out.line(line)
    else:
        for row in lint.in_order(found).select(report.text_line_without_column().alias("t")).toLocalIterator():
            out.line(row["t"])
        out.line(report.summary_line(docs.count(), total["errors"], total["warnings"]))
    if report.failed(found, args.strict).first()["failed"]:
        if args.format == "text":
            out.error("Errors were found." if total["errors"] else "Warnings were found in a strict run.")
        out.fail()
    found.unpersist()
    docs.unpersist()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code. Version comes before help, help before validation, validation before linting."""
    out = Output()
    try:
        args = parser().parse_args(argv)
        out = Output(args.log, args.silent)
        if args.version:
            out.line(VERSION)
        elif args.help:
            out.line(parser().format_help())
        elif args.validate:
            with tempfile.TemporaryDirectory(prefix="quillframe-") as folder:
                checks = run_checks(spark or session(), folder)
            out.line(f"{'#' * args.depth} Self-checks of quillframe {VERSION}")
            for name, problem in checks:
                out.line(f"{'Passed' if problem is None else 'Failed'}: {name}" + (f" ({problem})" if problem else ""))
            failed = sum(p is not None for _, p in checks)
            out.line(f"Total: {len(checks)}, passed: {len(checks) - failed}, failed: {failed}")
            if args.results:
                Path(args.results).write_text(results_file(checks, args.results), encoding="utf-8")
            if failed:
                out.fail()
        else:
            if args.format == "text":
                out.line(f"quillframe {VERSION}")
            run_lint(spark or session(), args, out)
    except (ValueError, OSError) as e:
        out.error(f"Error: {e}")
    code = out.exit_code
    out.close()
    return code


if __name__ == "__main__":
    sys.exit(main())
