"""Toxicity, language and quality: held-out accuracy, folds and brute-force measures."""

import random
import re
import zlib

import numpy as np
import pytest

from quillframe.llm import langid, quality, queries, toxicity
from quillframe.llm.common import WordHash

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_toxicity_held_out(spark, labels):
    got = queries.op4_pu_toxicity(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]["toxic"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    caught = [p for p, t in held if t == 1]
    wrong = [p for p, t in held if t == 0]
    assert sum(caught) / len(caught) > 0.7 and sum(wrong) / len(wrong) < 0.02


def test_toxicity_reads_no_held_out_label(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = marks.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = toxicity.fit(docs, marks), toxicity.fit(docs, flipped)
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_pu_risk_recovers_hidden_positives():
    r = np.random.default_rng(0)
    word = lambda toxic: np.unique(np.r_[r.integers(100, 5000, 30), r.integers(0, 5, 2) if toxic else [9]]).astype(np.int32)
    truth = r.random(3000) < 0.15
    model = toxicity.train([word(True) for _ in range(400)], [word(t) for t in truth], 0.15)
    z = lambda s: model.bias + model.weight[s].sum()
    fresh = [(z(word(t)), t) for t in r.random(1000) < 0.5]
    assert np.mean([(s >= np.log(0.7 / 0.3)) == t for s, t in fresh]) > 0.97


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_slope_of_the_risk(shift):
    """Against differences of the risk itself; where the negative part is below zero, of that part turned round."""
    r = np.random.default_rng(1)
    x_p, x_u, w, b, prior = r.random((40, 6)) + 1, r.random((60, 6)) < 0.3, r.normal(size=6), 0.3, 0.4
    if shift:
        w, b = np.abs(w) + 1, shift
    loss = lambda z: np.log1p(np.exp(-z))
    parts = lambda v: (prior * loss(x_p @ v[:-1] + v[-1]).mean(), loss(-(x_u @ v[:-1] + v[-1])).mean() - prior * loss(-(x_p @ v[:-1] + v[-1])).mean())
    v = np.r_[w, b]
    positive, negative, slope = toxicity.risk(x_p, x_u, w, b, prior)
    assert np.allclose((positive, negative), parts(v)) and (negative < 0) == bool(shift)
    whole = (lambda v: -parts(v)[1]) if negative < 0 else (lambda v: sum(parts(v)))
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert abs((whole(v + step) - whole(v - step)) / 2e-6 - slope[k]) < 1e-5


def test_shares_by_hand(spark):
    """Corrected shares of a filter against sets of the n-grams that it was built from; and rare languages keep theirs."""
    texts = {"aa": ["the moon rises over the hill", "over the moon and hill"], "bb": ["der mond steigt auf den berg", "auf dem berg der mond"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own for _ in range(40))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    plain = lambda t: " " + "".join(c if c.isalpha() else " " for c in t.lower()) + "  "
    windows = lambda t: [plain(t)[i : i + 4] for i in range(len(plain(t)) - 3)]
    held = {lang: {g for t in own for g in windows(t)} for lang, own in texts.items()}
    for text in ("the mond over berg", "hill und auf", "zzz"):
        n = windows(text)
        for k, lang in enumerate(model.langs):
            share = sum(g in held[lang] for g in n) / len(n)
            assert abs(model.shares([text])[0, k] - max(0.0, (share - model.chance[k]) / (1 - model.chance[k]))) < 0.02
    many = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "big") for i in range(400)] + [(1000 + i, "kleine sprache mit wenig text", "rare") for i in range(30)]
    few = langid.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"), fit_grams=200)
    assert few.decide(["kleine sprache"])[0] == ["rare"]


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op6_language_id(spark, SF).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) > 0.99
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_bloom_filter_holds_every_gram():
    r = np.random.default_rng(2)
    gram, lang = r.integers(0, 2**32, 3000).astype(np.uint32), r.integers(0, 70, 3000)
    model = langid.Filter.build([f"l{i:02}" for i in range(70)], gram, lang)
    slots = langid.Filter.slots(gram)
    mask = np.bitwise_and(*(model.masks[s] for s in slots))
    assert (mask[np.arange(3000), lang // 64] >> (lang % 64).astype(np.uint64) & np.uint64(1)).all()
    assert model.masks.shape[1] == 2


def test_language_without_letters(spark, odd_docs, no_docs):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. 😀"), (4, "É"), (5, "the and of")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identified(rows, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] != "und" and got[5] == "en"
    assert langid.identified(odd_docs, langid.fit(odd_docs)).count() == 12
    empty = langid.fit(no_docs)
    assert langid.identified(no_docs, empty).count() == 0 and {r["lang_pred"] for r in langid.identified(odd_docs, empty).collect()} == {"und"}


def by_hand(text):
    text = text or ""
    words, windows = re.findall(r"[^\x20\x09-\x0D]+", text), {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_measures(spark, odd_docs):
    r = random.Random(1)
    made = [" ".join(r.choice("a b c d#\n é|") for _ in range(r.randint(0, 40))) for _ in range(300)]
    rows = list(enumerate(made)) + [(1000 + x["doc_id"], x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = dict(rows)
    for x in quality.measured(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == by_hand(texts[x["doc_id"]])


def test_quality_held_out(spark, labels):
    got = {r["doc_id"]: r for r in queries.op10_quality_rules(spark, SF).collect()}
    for r in got.values():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    left = [(got[i]["kept"], x["quality"]) for i, x in labels.items() if not got[i]["base_failed"]]
    assert np.mean([k for k, q in left if q == 1]) > 0.995 and np.mean([k for k, q in left if q == 0]) < 0.1


def test_decision_list_generalises():
    r = np.random.default_rng(3)
    x = {k: r.random(4000) for k in quality.FEATURES}
    bad = ((x["symbol_share"] >= 0.8) & (x["word_length"] < 0.5)) | (x["dup_line_share"] >= 0.9)
    rules = quality.learn(x, bad)
    fresh = {k: r.random(4000) for k in quality.FEATURES}
    truth = ((fresh["symbol_share"] >= 0.8) & (fresh["word_length"] < 0.5)) | (fresh["dup_line_share"] >= 0.9)
    said = np.any([quality.covers(u, fresh) for u in rules], axis=0)
    assert np.mean(said == truth) > 0.98 and all(1 <= len(u) <= quality.MAX_CONDITIONS for u in rules)
    assert quality.learn(x, np.zeros(4000, bool)) == [] and quality.learn(x, np.ones(4000, bool)) == []


def test_odd_rows(spark, odd_docs, no_docs):
    marks = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 1, 1), (2, None, None), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for docs, n in ((odd_docs, 12), (no_docs, 0)):
        for m in (marks, marks.limit(0)):
            assert quality.judged(docs, m).count() == n
            scored = toxicity.scored(docs, toxicity.fit(docs, m)).collect()
            assert len(scored) == n and all(r["held_out"] is None for r in scored if r["doc_id"] is None)
    kept = quality.passing(odd_docs, marks)
    assert kept.columns == odd_docs.columns
    assert WordHash().many([]).size == 0
