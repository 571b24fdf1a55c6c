"""Reports and findings are made in one pass."""

import json

from pyspark.sql import functions as F
from quillframe.operators import lexicon
from quillframe.plans import lint, queries, report

TEXTS = (
    "# A\n\nThe test is opened; it isn't a testing. We utilize a lot of heat in the event of testing.",
    "- b\n\nThe impact has been opened. To impact it, start prior  to the event (The test was opened.) now.",
    "`utilize` x\x01utilize the \x01 thing; it isn't re-testing prior\x01to a test. A lot  of\theat.",
    "",
)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_json_report_makes_findings_once(spark, docs):
    frame = docs(*TEXTS)
    found = lint.findings(frame, queries.CONFIG, lexicon.table(spark, queries.ENTRIES))
    rows = report.json_rows(frame, found)
    assert plan_of(rows).count("(?dm)^(?:[HT]") == 1
    told = [r["report"] for r in rows.collect()]
    assert json.loads("\n".join(report.json_lines(told))) == json.loads(report.json_report(frame, found).first()["report"])


def test_json_report_of_odd_values(spark):
    odd = [("a\x00\u2028.md", 1, 0, 1, 2, 3, "X", "warn", 'm ,"pass":9}', None), (None, 1, 0, 1, 2, 3, "X", "error", '\\"\n', ',"pass":1,"seg_ord":0'), ("a\x00\u2028.md", 1, 0, 1, 1, 3, "Y", "off", "", "")]
    found = spark.createDataFrame(odd, "file string, pass int, seg_ord int, rank int, offset int, line int, rule_code string, severity string, message string, suggestion string")
    frame = spark.createDataFrame([(r[0], "") for r in odd], "file string, content string")
    told = [json.loads(r["report"]) for r in report.json_rows(frame, found).collect()]
    assert told[0] == {"filesChecked": 2, "errorCount": 1, "warningCount": 1}
    assert [(r["file"], r["line"], r["column"], r["ruleCode"], r["severity"], r["message"], r["suggestion"]) for r in told[1:]] == [(r[0], r[5], None, r[6], r[7], r[8], r[9]) for r in (odd[1], odd[2], odd[0])]


def test_findings_are_made_in_the_row(spark, docs, monkeypatch):
    from quillframe.operators import terms

    entries = (*queries.ENTRIES, ("C++", (("noun", ("C",)),)), ("a test of a", (("any", ("x",)),)), ("prior to a", ()))
    more = ("Use C++ prior to a Test. A LOT OF tests; prıor to it. In the  Event of an event, a test of a test.", "a lot, of; in the, event of. IN THE EVENT OF")
    frame = docs(*TEXTS, *more)
    small = lint.findings(frame, queries.CONFIG, lexicon.table(spark, entries))
    assert "Join" not in plan_of(small)
    monkeypatch.setattr(terms, "TABLE_TERMS", 0)
    joined = lint.findings(frame, queries.CONFIG, lexicon.table(spark, entries))
    assert "BroadcastHashJoin" in plan_of(joined)
    rows = sorted(map(str, small.collect()))
    assert rows == sorted(map(str, joined.collect())) and sum("STE100-DICT" in r for r in rows) > 15


def test_matches_in_texts_with_the_sign(spark):
    from quillframe.functions import patterns as P
    from quillframe.functions.text import SIGN, located

    text = "`a` Testing, it isn't\x02 re-doing. İng lıkıng \U0001f600 x-making- "
    frame = spark.createDataFrame([(text,), (text + SIGN,), (SIGN + SIGN + text,), ("",), (SIGN,)], "text string")
    found = [r["m"] for r in frame.select(located(F.col("text"), f"{P.CODE}|{P.ING_FORM}", gaps=True).alias("m")).collect()]
    assert [(m["start"], m["end"], m["value"]) for m in found[0]] == [(m["start"], m["end"], m["value"]) for m in found[1]] == [(m["start"] - 2, m["end"] - 2, m["value"]) for m in found[2]]
    assert [m["value"] for m in found[0]] == ["`a`", "Testing", "re-doing", "lıkıng", "x-making"] and found[3:] == [[], []]
    assert all(m["value"] == text[m["start"] : m["end"]] for m in found[0])


def test_words_are_counted_where_they_can_be_over(spark):
    from quillframe.operators.sentences import counted_over, word_count

    texts = ["One two (three four) 5 kg `a b` \"c d\" Big Red Box.", "A b c d.", "A  b\tc d e", "A b c d e f", ""]
    frame = spark.createDataFrame([(t, n) for t in texts for n in (-1, 0, 3, 4, 5, 8, 2**31 - 1)], "t string, n int")
    for r in frame.select("n", word_count(F.col("t")).alias("all"), counted_over(F.col("t"), F.col("n")).alias("over")).collect():
        assert r["over"] == (r["all"] if r["all"] > r["n"] else None)


def test_gate_reads_documents_once(spark, docs, monkeypatch):
    from quillframe.operators import rules
    from quillframe.sources.config import Config

    monkeypatch.setattr(queries, "markdown_docs", lambda spark, sf_dir: docs(*TEXTS))
    gate = queries.QUERIES["gate_exit"](spark, "")
    assert plan_of(gate).count("(?dm)^(?:[HT]") == 1 and gate.dtypes == [("strict", "boolean"), ("failed", "boolean")]
    some = ("", None, "A.", "It isn't.", "A; b.", "The door was opened.", "It has opened.", "Re-testing.", "A. B. C. D. E. F. G.", "A b c d e f.")
    kinds = ({}, {"passive_voice": "error"}, {"complex_verb": "error", "passive_voice": "off", "max_words_descriptive": 5}, {"ing_form": "error", "max_sentences_paragraph": 0}, {"ing_form": "off", "passive_voice": "off", "complex_verb": "off", "allow_semicolons": True, "allow_contractions": True})
    for knobs in kinds:
        segments = lint.prepared(docs(*some), Config(rules=knobs))
        found = rules.structural(segments)
        bad = {r["file"]: (r["e"], r["w"]) for r in found.groupBy("file").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warn").alias("w")).collect()}
        worst = rules.with_sentences(segments, counted=False).select("file", rules.worst().alias("w")).groupBy("file").agg(F.bool_or("w.error").alias("e"), F.bool_or("w.some").alias("s"))
        for r in worst.collect():
            e, w = bad.get(r["file"], (0, 0))
            assert (r["e"], r["s"]) == (e > 0, e + w > 0), (knobs, r)
        strict, plain = report.gate(segments).collect()
        assert strict["strict"] and not plain["strict"]
        assert (strict["failed"], plain["failed"]) == (report.failed(found, True).first()["failed"], report.failed(found).first()["failed"])
    assert [tuple(r) for r in report.gate(lint.prepared(docs("A."), Config())).collect()] == [(True, False), (False, False)]
    assert [tuple(r) for r in report.gate(lint.prepared(docs("A."), Config()).limit(0)).collect()] == [(True, False), (False, False)]


def test_documents_of_one_row_group_are_dealt(spark, tmp_path):
    spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("src1").alias("source"), F.lit("A test.").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    table = queries.markdown_docs(spark, tmp_path)
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes(table)) == 1 and "repartition" not in str(queries.dealt(table, least=2_001)._jdf.queryExecution().logical()).lower()
    found = queries.dealt(table)
    assert len(sizes(found)) >= 4 and max(sizes(found)) < 500 and sorted(found.collect()) == sorted(table.collect())
    even = table.repartition(8)
    assert queries.dealt(even) is even
    assert "REPARTITION_BY_NUM" in queries.QUERIES["finding_order"](spark, tmp_path)._jdf.queryExecution().executedPlan().toString()
