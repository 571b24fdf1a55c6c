import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.plans import relint, report
from quillframe.plans.lint import findings, lint
from quillframe.sources.config import Config
from quillframe.streaming import lint as stream

TEXTS = [(f"{'abc'[i % 3]}/{i:03}.md", f"The door was opened; it isn't shut. Ropes number {i} were coiled.\n\n- \"Item\" {i}; two") for i in range(60)] + [("clean.md", "We paint walls.")]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(TEXTS, "file string, content string")
    return docs, findings(docs).cache()


def told(df):
    return sorted(map(str, df.select("file", "line", "rule_code", "severity", "message", "suggestion").collect()))


def test_numbers_are_those_of_one_window(spark, found):
    _, rows = found
    keys = ["file", "pass", "seg_ord", "rank", "offset", "message"]
    plain = rows.withColumn("number", F.row_number().over(Window.orderBy(*keys)))
    got = report.numbered(rows.repartition(7), tuple(keys), parts=5)
    assert got.rdd.getNumPartitions() > 1 and sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert report.numbered(rows.limit(0)).count() == 0


def test_json_of_many_files(spark, found, tmp_path):
    docs, rows = found
    plain = "".join(f"{x}\n" for x in report.json_lines(r["report"] for r in report.json_rows(docs, rows).collect()))
    for k, some in enumerate((rows, rows.limit(0))):
        path = tmp_path / str(k)
        report.write_json(docs, some, path.as_uri(), parts=5)
        names = [r["name"] for r in spark.read.json(f"{path.as_uri()}/manifest").orderBy("name").collect()]
        whole = "".join((path / "parts" / n).read_text(encoding="utf-8") for n in names)
        assert len(json.loads(whole)["diagnostics"]) == some.count() and (k or whole == plain and len(names) > 1)


def test_only_changes_are_linted(spark, tmp_path):
    path = tmp_path.as_uri()
    table = lambda rows: spark.createDataFrame(rows, "file string, content string")
    assert relint.relint(table(TEXTS), path) == 1
    changed = [(f, "Now; then.") if f == "a/003.md" else (f, c) for f, c in TEXTS if f != "b/001.md"] + [("new.md", "It isn't; new.")]
    assert relint.relint(table(changed), path) == 2
    assert {r["file"] for r in spark.read.parquet(f"{path}/findings/run=2").select("file").distinct().collect()} == {"a/003.md", "new.md"}
    assert told(relint.current(spark, path)) == told(lint(table(changed)))
    # a run without a ledger is none
    table([("x.md", "It isn't; lost.")]).write.parquet(f"{path}/ledger/run=3")
    (tmp_path / "ledger" / "run=3" / "_SUCCESS").unlink()
    assert relint.runs(spark, path) == [1, 2]
    strict = Config(rules={"allow_semicolons": True})
    assert relint.relint(table(changed), path, strict) == 3 and told(relint.current(spark, path)) == told(lint(table(changed), strict))


def test_counts_of_a_stream(spark, tmp_path):
    """A file that comes twice counts once, in one batch or in two."""
    source, out, mark = (tmp_path / n for n in ("in", "out", "mark"))
    schema = "file string, content string, version int"

    def send(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet((source / name).as_uri())
        files = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source.as_uri())
        stream.count_to(files, out.as_uri(), mark.as_uri(), version="version").awaitTermination()

    send([(f, c, 1) for f, c in TEXTS] + [("a/000.md", "Fine now.", 2), ("z.md", "It isn't; so.", 2), ("z.md", "Good.", 1)], "1")
    send([("b/001.md", "All is well.", 1)], "2")
    last = dict(TEXTS) | {"a/000.md": "Fine now.", "z.md": "It isn't; so.", "b/001.md": "All is well."}
    docs = spark.createDataFrame(list(last.items()), "file string, content string")
    rows = findings(docs)
    assert sorted(stream.latest(spark, out.as_uri()).collect()) == sorted(report.by_file(docs, rows).collect())
    got, plain = stream.totals(spark, out.as_uri()).first(), report.counts(rows).first()
    assert (got["files"], got["errors"], got["warnings"], got["failed"]) == (len(last), plain["errors"], plain["warnings"], report.failed(rows).first()["failed"])
