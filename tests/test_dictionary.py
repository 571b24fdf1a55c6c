import time

import pytest
from pyspark.sql import functions as F

from quillframe.operators import joined_terms, lexicon, terms
from quillframe.operators.pos import guess
from quillframe.plans.lint import dictionary_findings, findings, prepared, with_phrase_spans
from quillframe.sources.config import Config, DictionaryConfig, Profile

POS = [
    ("They plan to impact sales.", "impact", "descriptive", "verb"),
    ("Torque the bolts at noon.", "Torque", "procedure", "verb"),
    ("Torque the bolts at noon.", "Torque", "descriptive", "verb"),
    ("Idle speed for keeping a pump cold or wet", "Idle", "procedure", None),
    ("The Larkspur impact shows near a dam.", "impact", "descriptive", "noun"),
    ("Notes list the rolling manual painted impact daily. The fan runs.", "impact", "descriptive", None),
    ("A wheel is our harbour test piece.", "test", "descriptive", "noun"),
    ("Lamps 3 and 4 use 9.5 watts.", "use", "descriptive", "verb"),
    ("x " * 400 + "We must impact it. The pump operates." + " y" * 400, "impact", "descriptive", "verb"),
    ("x" * 500 + " the impact is " + "y" * 500, "impact", "descriptive", "noun"),
]
SEED = [
    ("utilize", (("verb", ("use",)),)),
    ("prior to", (("any", ("before",)),)),
    ("impact", (("noun", ("effect",)), ("verb", ("affect",)))),
    ("a lot of", (("any", ("much", "many", "plenty", "lots")),)),
    ("mix", (("noun", ("mixture",)), ("verb", ("blend",)))),
    ("test", (("verb", ("test",)),)),
    ("support", (("noun", ("support", "hold")), ("verb", ("hold", "support")))),
    ("c++", (("any", ()),)),
    ("go go", (("any", ("run",)),)),
    ("empty", ()),
]
CASES = [
    ("Please utilize a rope.", ["Avoid 'utilize'; use 'use' instead."]),
    ("Wash a boat prior\nto painting.", ["Avoid 'prior to'; use 'before' instead."]),
    ("A rope was utilized at noon, and re-utilize or utilize-d.", []),
    ("Turn the utilize knob.", []),
    ("An impact is loud.", ["Avoid 'impact'; use 'effect' instead (used as a noun)."]),
    ("Rain could impact our harvest.", ["Avoid 'impact'; use 'affect' instead (used as a verb)."]),
    ("They discuss Impact sometimes. The team operates daily.", ["Ambiguous part of speech for 'Impact' — possible corrections: as a noun, use 'effect'; as a verb, use 'affect'."]),
    ("They produce a lot of heat.", ["Avoid 'a lot of'; use 'much', 'many', 'plenty', or 'lots' instead."]),
    ("Use `utilize` and `prior to` here.", []),
    ("They discuss test sometimes. The team operates daily.", []),
    ("Our support is here.", []),
    ("Write C++ code.", ["Avoid 'C++'; it is not an approved ASD-STE100-style term."]),
    ("They go go go go away.", ["Avoid 'go go'; use 'run' instead."] * 2),
    ("They discuss empty sometimes. The team operates daily.", ["Ambiguous part of speech for 'empty' — possible corrections: ."]),
]


@pytest.fixture(scope="module")
def entries(spark):
    return lexicon.table(spark, SEED)


def test_guess(spark):
    rows = [(t, t.index(w), t.index(w) + len(w), m, e) for t, w, m, e in POS]
    got = spark.createDataFrame(rows, "t string, s int, e int, m string, x string").select("t", "x", guess(F.col("t"), F.col("s"), F.col("e"), F.col("m")).alias("g")).collect()
    assert [(r["t"][:60], r["g"]) for r in got] == [(r["t"][:60], r["x"]) for r in got]


def test_findings(spark, entries):
    frame = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(CASES)], "file string, content string")
    config = Config()
    got = {}
    for r in dictionary_findings(prepared(frame, config), entries, config).orderBy("file", "seg_ord", "rank", "offset").collect():
        got.setdefault(int(r["file"]), []).append(r["message"])
    for i, (text, expected) in enumerate(CASES):
        assert got.get(i, []) == expected, text


def test_allowances(spark, docs, entries):
    config = Config(
        profiles=[Profile("a/*", allow=["UTILIZE"], allow_in_phrase=["Garden mix"])],
        dictionary=DictionaryConfig(ignore=["a lot of"]),
    )
    text = "Please utilize a lot of ropes. Stir a garden\nmix bowl, and then smell our soup mix."
    got = dictionary_findings(prepared(docs(("a/x.md", text), ("b/x.md", text)), config), entries, config).collect()
    assert sorted((r["file"], r["message"].split("'")[1]) for r in got) == [("a/x.md", "mix"), ("b/x.md", "mix"), ("b/x.md", "mix"), ("b/x.md", "utilize")]


def test_layers(spark):
    base = lexicon.table(spark, [("Utilize", (("verb", ("use",)),)), ("x", (("any", ()),))])
    over = lexicon.table(spark, [("utilize", (("verb", ("apply",)),))])
    got = {r["term"]: r["senses"][0]["alternatives"] for r in lexicon.merged(base, over, removed=("X",)).collect()}
    assert got == {"utilize": ["apply"]}
    assert lexicon.lookup(base, "UTILIZE").count() == 1


def test_no_terms(spark, docs):
    empty = lexicon.table(spark, [])
    assert terms.matches(prepared(docs("Some text."), Config()), empty).count() == 0


def test_large_dictionary(spark, docs, monkeypatch, entries):
    frame = prepared(docs("Please utilize it prior to use."), Config())
    few = sorted((r["term"], r["start"], r["end"]) for r in terms.matches(frame, entries).collect())
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 2)
    plain = entries.where(~F.col("term").isin("c++", "go go"))
    assert sorted((r["term"], r["start"], r["end"]) for r in terms.matches(frame, plain).collect()) == few


def test_large_dictionary_has_all_terms(spark, docs, monkeypatch):
    odd = ["c++", "go go", "and/or", "café", "++", "m²", "a\\Eb", "naïve plan", "x  y", "İ/o", "ẞ/t", "R&D plan"]
    entries = lexicon.table(spark, [*SEED[:4], *((t, (("any", ("other",)),)) for t in odd)])
    texts = ["Write C++ and/or go go go go CAFÉ, (++) m² per A\\EB; naïve  plan utilize it prior to use.", "x  y `c++` i/O ß/t r&d\nplan. c++x re-and/or +++ C++ c++", "They go. Go go Go.", "It's the valve; nothing else."]
    frame = docs(*texts)
    matched = lambda: sorted((r["file"], r["term"], r["start"], r["end"], r["match"]) for r in terms.matches(prepared(frame, Config()), entries).collect())
    linted = lambda: sorted(tuple(r) for r in findings(frame, Config(), entries).drop("suggestion").collect())
    few, lint_few = matched(), linted()
    assert {t for _, t, *_ in few} >= {*odd, "utilize", "prior to"}
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 2)
    assert matched() == few
    assert linted() == lint_few


def test_large_dictionary_with_blank_terms(spark, docs, monkeypatch):
    entries = lexicon.table(spark, [(t, (("any", ()),)) for t in (" ", "plain", "other")])
    frame = prepared(docs("A plain ( ) word.", "Nothing."), Config())
    few = sorted((r["term"], r["start"], r["end"]) for r in terms.matches(frame, entries).collect())
    assert (" ", 9, 10) in few
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 2)
    assert sorted((r["term"], r["start"], r["end"]) for r in terms.matches(frame, entries).collect()) == few


def test_large_dictionary_with_long_terms_and_repeats(spark, docs, monkeypatch):
    """Terms of three words and more are compared with the text; files that repeat each get their own matches."""
    entries = lexicon.table(spark, [(t, (("any", ("other",)),)) for t in ("out of the way", "out of", "of the", "the way it goes", "way")])
    texts = [("a.md", "Out  of the\nway it goes. out of the, way."), ("a.md", "Out  of the\nway it goes. out of the, way."), (None, "of the way it\tgoes; the way it-goes")]
    matched = lambda: sorted(map(str, terms.matches(prepared(docs(*texts), Config()), entries).select("file", "term", "start", "end", "match").collect()))
    few = matched()
    assert len(few) > 10
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 2)
    assert matched() == few


def test_large_dictionary_shuffles_in_proportion(spark, docs, monkeypatch):
    """A paragraph four times as long costs four times the bytes, and places without a match none; the join has no null keys."""
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 2)
    entries = lexicon.table(spark, [(f"term{i}", (("any", ("other",)),)) for i in range(50)])
    found = terms.index(entries)

    def shuffled(n):
        text = " ".join(f"term{i % 50}" if i % 3 == 0 else f"plain{i}" for i in range(n))
        hits = terms.found_in(prepared(docs(text), Config()), found)
        rows = joined_terms.keys_of(F.col("text"), terms._folded, terms._SYMBOL, found)
        kept = prepared(docs(text), Config()).select(F.explode(rows).alias("k")).where(found.may_hold(F.col("k.key")))
        assert kept.where("k.key is null").count() == 0 and kept.count() < n // 3 + n // 50
        store = spark.sparkContext._jsc.sc().statusStore()
        total = lambda: store.executorList(True).apply(0).totalShuffleWrite()
        time.sleep(1)
        before = total()
        assert hits.count() == -(-n // 3)
        time.sleep(1)
        return total() - before

    shuffled(300)
    small, large = shuffled(2000), shuffled(8000)
    assert large < 6 * small


def test_ten_thousand_phrases(spark, docs):
    """The plan has no pattern a phrase."""
    phrases = [f"word{i} of phrase" for i in range(10_000)] + ["c++ code", "Fuel mix", "go go on", "fuel"]
    config = Config(dictionary=DictionaryConfig(allow_in_phrase=phrases))
    began = time.time()
    rows = with_phrase_spans(prepared(docs("The fuel  MIX is word77 of\nphrase, word9999 of phrases; c++ code go go go on."), config), config).select("text", "phrase_spans").collect()
    told = sorted(rows[0]["text"][s["start"] : s["end"]] for s in rows[0]["phrase_spans"])
    assert told == ["c++ code", "fuel", "fuel  MIX", "go go on", "word77 of phrase"] and time.time() - began < 30
