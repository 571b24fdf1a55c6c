"""Each stage against plain Python on its own input."""

import corpus_pipeline as cp
import pytest

from quillframe.llm.common import keep

from . import test_decontaminate, test_linededup, test_ngram_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(keep(stage(spark, out[-1], SF), name))
    return [(d.columns, {r["doc_id"]: r for r in d.collect()} if "text" in d.columns else d.collect()) for d in out]


def test_shape(steps):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for c, _ in steps[:-1])


def test_quality(spark, steps):
    from quillframe.llm import queries

    kept = {r["doc_id"] for r in queries.op10_quality_rules(spark, SF).where("kept").collect()}
    assert set(steps[1][1]) == kept and all(steps[1][1][i] == steps[0][1][i] for i in kept)


def test_lines(steps):
    before, after = steps[1][1], steps[2][1]
    gone = test_linededup.by_hand([(i, r["text"]) for i, r in before.items()], 80, 1)
    left = {i: "\n".join(x for k, x in enumerate(r["text"].split("\n")) if (i, k) not in gone) for i, r in before.items()}
    assert set(after) == {i for i, t in left.items() if t.split()} and len(after) < len(before)
    for i, r in after.items():
        text = "\n".join(x for k, x in enumerate(before[i]["text"].split("\n")) if (i, k) not in gone)
        assert r["text"] == text and (r["n_chars"] == len(text) or text == before[i]["text"])


def test_copies(steps):
    before, after = steps[2][1], steps[3][1]
    groups = test_ngram_join.by_hand([(i, r["text"]) for i, r in before.items()], 5, 80)
    assert set(after) == {i for i, (_, root) in groups.items() if root == i}


def test_contaminated(spark, steps):
    before, after = steps[3][1], steps[4][1]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    marks = test_decontaminate.by_hand([(i, r["text"]) for i, r in before.items()], items)
    assert set(after) == {i for i, m in marks.items() if not m[4]}
    windows = test_decontaminate.windows_of(items)
    for i, r in after.items():
        words = test_decontaminate.words(before[i]["text"])
        hit = {k + d for n in {len(x) for x in windows} for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for d in range(n)}
        assert test_decontaminate.words(r["text"]) == [w for k, w in enumerate(words) if k not in hit]
        assert (r["text"] == before[i]["text"]) == (not hit) and (r["n_chars"] == len(r["text"]) or not hit)


def test_packed(steps):
    assert {r["doc_id"] for r in steps[5][1]} == set(steps[4][1])


def test_odd_rows(spark, odd_docs, tmp_path):
    docs = odd_docs.selectExpr("doc_id", "text", "lang", "source", "key as n_chars")
    for name, stage in cp.STAGES[1:]:
        docs = keep(stage(spark, docs, SF), name)
    assert docs.count() > 0
    empty = odd_docs.selectExpr("*", "key as n_chars").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
