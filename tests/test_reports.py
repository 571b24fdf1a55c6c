import json
import xml.etree.ElementTree as X

import pytest
from pyspark.sql import functions as F

from quillframe.cli import main
from quillframe.operators import lexicon
from quillframe.plans import lint, report
from quillframe.plans.validate import results_file
from quillframe.sources.config import Config, DictionaryConfig
from quillframe.streaming.lint import lint_to

BAD = "Stop; go.\n\nThe valve is opened daily.\n\n# It's\n"


@pytest.fixture
def found(docs):
    return lint.findings(docs(("b.md", BAD), ("a.md", "Please utilize the tool; now.")), Config()).cache()


def test_text_report(found):
    got = [r["t"] for r in lint.in_order(found).select(report.text_line_without_column().alias("t")).collect()]
    assert got == [
        "a.md:1: [ERROR] STE100-8.1 — Semicolons are not permitted in ASD-STE100 prose. (Suggestion: Split into two separate sentences.)",
        "a.md:1: [ERROR] STE100-DICT — Avoid 'utilize'; use 'use' instead. (Suggestion: use)",
        "b.md:1: [ERROR] STE100-8.1 — Semicolons are not permitted in ASD-STE100 prose. (Suggestion: Split into two separate sentences.)",
        'b.md:3: [WARN] STE100-ADV-PASSIVE — Possible passive voice (advisory heuristic, not an official STE100 rule): "The valve is opened daily." (Suggestion: Consider rewriting in active voice.)',
        "b.md:5: [ERROR] STE100-4.2 — Contraction 'It's' is not permitted in ASD-STE100 prose. (Suggestion: Write the words in full.)",
    ]


def test_json_report(docs, found):
    got = json.loads(report.json_report(docs(("a.md", ""), ("b.md", ""), ("c.md", "")), found).first()["report"])
    assert (got["filesChecked"], got["errorCount"], got["warningCount"], len(got["diagnostics"])) == (3, 4, 1, 5)
    assert got["diagnostics"][0] | {"message": ""} == {"file": "a.md", "line": 1, "column": None, "ruleCode": "STE100-8.1", "severity": "error", "message": "", "suggestion": "Split into two separate sentences."}


def test_gate(docs):
    warn = lint.findings(docs("The valve is opened daily."), Config())
    assert [report.failed(warn, s).first()["failed"] for s in (False, True)] == [False, True]
    assert not report.failed(lint.findings(docs("Open it."), Config()), True).first()["failed"]


def test_dictionary_switch(docs):
    config = Config(dictionary=DictionaryConfig(enabled=False, file="missing.yaml"))
    assert lint.lint(docs("Please utilize the tool."), config).count() == 0


def test_by_file_and_rule(docs, found):
    rows = {r["file"]: (r["errors"], r["warnings"]) for r in report.by_file(docs(("a.md", ""), ("b.md", ""), ("z.md", "")), found).collect()}
    assert rows == {"a.md": (2, 0), "b.md": (2, 1), "z.md": (0, 0)}
    assert {r["rule_code"]: r["findings"] for r in report.by_rule(found).collect()}["STE100-8.1"] == 2


def test_table_sinks(spark, found, tmp_path):
    report.write_table(found, str(tmp_path / "t"))
    report.write_text(found.withColumn("column", F.lit(None).cast("int")), str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.text(str(tmp_path / "x")).count() == 5


def test_no_shuffle_of_documents(docs):
    plan = lint.lint(docs(BAD), Config(), None)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_partitions_do_not_matter(spark, docs, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(f"{i}.md", BAD + "Please utilize the tool.") for i in range(30)]
        got = lint.lint(docs(*rows).repartition(int(partitions)), Config()).groupBy("rule_code").count().collect()
        assert {r["rule_code"]: r["count"] for r in got} == {"STE100-8.1": 30, "STE100-ADV-PASSIVE": 30, "STE100-4.2": 30, "STE100-DICT": 30}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream(spark, docs, tmp_path):
    docs(("a.md", BAD), ("b.md", "Please utilize the tool.")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, content string").parquet(str(tmp_path / "in"))
    words = lexicon.table(spark, lexicon.SEED)
    lint_to(stream, str(tmp_path / "out"), str(tmp_path / "log"), Config(), words).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("The valve is opened daily.")
    (tmp_path / "b.txt").write_text("Stop; go.")
    run = lambda *a: main([*a, "--root", str(tmp_path)], spark)
    assert run() == 0 and "Checked 1 file(s): 0 error(s), 1 warning(s)." in capsys.readouterr().out
    assert run("--strict") == 1 and "strict" in capsys.readouterr().err
    assert run("*.txt", "--format", "json") == 1
    assert json.loads(capsys.readouterr().out)["errorCount"] == 1
    assert run("--silent", "--log", str(tmp_path / "log")) == 0 and not capsys.readouterr().out
    assert "Checked 1 file(s)" in (tmp_path / "log").read_text()
    assert run("--nonsense") == 1 and "Error:" in capsys.readouterr().err
    assert run("--config", str(tmp_path / "no.yaml")) == 1
    (tmp_path / ".quillframe.yaml").write_text("rules: {passive-voice: off}")
    assert run("--strict") == 0
    assert main(["--version", "--help"]) == 0 and capsys.readouterr().out.strip().endswith("0.1.0")
    assert main(["--help"]) == 0 and "--strict" in capsys.readouterr().out


def test_validation(spark, tmp_path, capsys):
    assert main(["--validate", "--depth", "2", "--results", str(tmp_path / "r.trx")], spark) == 0
    assert capsys.readouterr().out.startswith("## Self-checks")
    assert X.parse(tmp_path / "r.trx").getroot().tag.endswith("TestRun")
    root = X.fromstring(results_file([("a", None), ("b", "why")], "x.XML"))
    assert root[0].get("failures") == "1"
    with pytest.raises(ValueError):
        results_file([], "x.txt")


def test_json_rows_are_the_report(docs, found):
    files = docs(("a.md", ""), ("b.md", ""), ("c.md", ""))
    rows = [r["report"] for r in report.json_rows(files, found).collect()]
    assert len(rows) == 6 and json.loads(rows[0]) == {"filesChecked": 3, "errorCount": 4, "warningCount": 1}
    assert json.loads("\n".join(report.json_lines(rows))) == json.loads(report.json_report(files, found).first()["report"])
    none = [r["report"] for r in report.json_rows(files, found.limit(0)).collect()]
    assert json.loads("\n".join(report.json_lines(none))) == {"filesChecked": 3, "errorCount": 0, "warningCount": 0, "diagnostics": []}


def test_registered_json_report_has_a_row_a_finding(docs, found, monkeypatch):
    from quillframe.plans import queries

    monkeypatch.setattr(queries, "markdown_docs", lambda spark, sf_dir: docs(("a.md", "")))
    monkeypatch.setattr(queries, "_found", lambda spark, sf_dir: found)
    assert queries.QUERIES["report_json"](None, "").count() == 6
