import random

import pytest

from quillframe.operators import line_blocks, markdown

PIECES = ["Text runs on.", "  more text", "# Head #", "##", "# ", "- item", "- ", "  - inner item", "1. one", "2)", "| a | b |", "| --- | --- |", "|  |", "```", "~~~~ code", "", " ", "[a](b) c", " ", "﻿x", "a\rb", "end\r"]


def documents(seed, n=60):
    r = random.Random(seed)
    make = lambda: "﻿" * (r.random() < 0.1) + "".join(r.choice(PIECES) + r.choice(["\n", "\n", "\n", "\r\n", ""]) for _ in range(r.choice([0, 1, 5, 40])))
    return [(f"f{i}.md", make()) for i in range(n)] + [(None, make() + "\nlast"), ("none.md", None)]


def told(rows):
    return sorted(((r["file"], r["seg_ord"], r["line"], r["role"], r["text"], r["line_offsets"]) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("block", [1, 3, 65_536])
def test_segments_are_those_of_whole_texts(spark, block):
    docs = spark.createDataFrame(documents(block), "file string, content string")
    whole = told(markdown.segments(docs))
    assert len(whole) > 150 and told(line_blocks.segments(line_blocks.lines_of(docs).repartition(3), block)) == whole


def test_files_that_spark_splits(spark, tmp_path):
    """Files of many splits, within fences and paragraphs too."""
    texts = {f"f{i}.md": "\n".join(t for _, t in documents(50 + i, 40) if t) for i in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = line_blocks.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 6
        got = told(line_blocks.segments(lines, 100))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    docs = spark.createDataFrame([((tmp_path / n).as_uri(), t) for n, t in texts.items()], "file string, content string")
    assert [x[1:] for x in got] == [x[1:] for x in told(markdown.segments(docs))] and len({x[0] for x in got}) == 3


def test_a_paragraph_over_many_blocks(spark):
    lines = spark.range(1, 30_001).selectExpr("'big.md' as file", "id as line_no", "case when id = 1 then '```' when id = 10000 then '```' else 'word' end as raw")
    got = line_blocks.segments(lines.repartition(5), 500).collect()
    assert len(got) == 1 and got[0]["line"] == 10_001 and len(got[0]["line_offsets"]) == 20_000 and got[0]["text"] == " ".join(["word"] * 20_000)


def test_no_task_holds_a_text(spark):
    """Windows are by file and block, never by file alone over lines."""
    lines = spark.range(1, 1001).selectExpr("'a.md' as file", "id as line_no", "'word' as raw")
    plan = line_blocks.segments(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert all("line_no" not in part.split("block")[0] for part in plan.split("windowspecdefinition(")[1:])
