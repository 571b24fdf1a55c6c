"""Self-checks: a few documents whose findings are known."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path
from xml.etree import ElementTree as X

from pyspark.sql import SparkSession

from ..operators import lexicon
from ..sources.config import Config, Profile
from ..sources.files import read_files, safe_join
from . import lint, report

CHECKS = (
    ("clean text has no findings", "Open the panel. Check the gauge.", Config(), []),
    ("a long sentence is found", " ".join(["word"] * 26) + ".", Config(), ["STE100-4.1"]),
    ("a semicolon and a contraction are found", "Stop; don't go.", Config(), ["STE100-4.2", "STE100-8.1"]),
    ("a term is found", "Please utilize the tool.", Config(), ["STE100-DICT"]),
    ("a profile applies", " ".join(["word"] * 22) + ".", Config(profiles=[Profile("check/**", mode="procedure")]), ["STE100-4.1"]),
)


def run_checks(spark: SparkSession, folder: str) -> list[tuple[str, str | None]]:
    """(name, problem or None) of each check.

    On a local master each text is written below ``folder`` and read as a file; elsewhere executors may not see the folder.
    """
    out, local = [], spark.sparkContext.master.split("[")[0] == "local"
    for name, text, config, expected in CHECKS:
        if local:
            path = Path(safe_join(folder, "check/a.md"))
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, encoding="utf-8")
            docs = read_files(spark, str(folder), globs=["check/a.md"])
        else:
            docs = spark.createDataFrame([("check/a.md", text)], "file string, content string")
        found = lint.findings(docs, config, lexicon.embedded(spark))
        codes = sorted(r["rule_code"] for r in found.collect())
        gate = report.failed(found).first()["failed"]
        out.append((name, None if codes == expected and gate == bool(expected) else f"found {codes}, expected {expected}"))
    return out


def results_file(checks: list[tuple[str, str | None]], path: str) -> str:
    """The results as TRX or JUnit XML, by the file's extension."""
    kind = path.lower().rpartition(".")[2]
    now = datetime.now(timezone.utc).isoformat()
    if kind == "xml":
        root = X.Element("testsuites")
        suite = X.SubElement(root, "testsuite", name="quillframe", tests=str(len(checks)), failures=str(sum(p is not None for _, p in checks)), timestamp=now)
        for name, problem in checks:
            case = X.SubElement(suite, "testcase", classname="quillframe", name=name)
            if problem:
                X.SubElement(case, "failure", message=problem)
    elif kind == "trx":
        root = X.Element("TestRun", name="quillframe", xmlns="http://microsoft.com/schemas/VisualStudio/TeamTest/2010")
        X.SubElement(root, "Times", creation=now)
        failed = sum(p is not None for _, p in checks)
        summary = X.SubElement(root, "ResultSummary", outcome="Failed" if failed else "Completed")
        X.SubElement(summary, "Counters", total=str(len(checks)), executed=str(len(checks)), passed=str(len(checks) - failed), failed=str(failed))
        results = X.SubElement(root, "Results")
        for name, problem in checks:
            one = X.SubElement(results, "UnitTestResult", testName=name, outcome="Failed" if problem else "Passed")
            if problem:
                info = X.SubElement(X.SubElement(one, "Output"), "ErrorInfo")
                X.SubElement(info, "Message").text = problem
    else:
        raise ValueError(f"results go to .trx or .xml files, not {path!r}")
    return X.tostring(root, encoding="unicode", xml_declaration=True)
