"""What plans must not do: make costly columns twice, shuffle documents. And the helpers that keep them cheap."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillframe.cli import parser
from quillframe.functions import patterns as P
from quillframe.functions.text import located, running, trimmed, trimmed_left
from quillframe.operators import lexicon, markdown, pos, terms
from quillframe.operators.pos import has_finite, normal
from quillframe.plans import lint, queries
from quillframe.plans.validate import results_file


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_and_guesses_are_made_once(spark, docs):
    frame = docs("# A\n\nThe test is opened. It's a test.", "- b")
    plan = physical(lint.lint(frame, queries.CONFIG, lexicon.table(spark, queries.ENTRIES)))
    assert plan.count("(?dm)^(?:[HT]") == 1 and plan.count("[+-]+\\z") == 1
    assert "Exchange hashpartitioning" not in plan


def test_any_of():
    r = random.Random(3)
    for _ in range(50):
        words = {"".join(r.choice("ab-c") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 30))}
        pattern = re.compile(P.any_of(sorted(words)))
        for probe in words | {"".join(r.choice("ab-c") for _ in range(r.randint(1, 6))) for _ in range(60)}:
            assert bool(pattern.fullmatch(probe)) == (probe in words)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_running(spark, n):
    r = random.Random(n)
    values = [r.randint(-50, 50) for _ in range(n)]
    frame = spark.createDataFrame([(values,)], "v array<int>")
    got = frame.select(running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), F.greatest).alias("m")).first()
    assert got["s"] == [sum(values[: i + 1]) for i in range(n)] and got["m"] == [max(values[: i + 1]) for i in range(n)]


def test_white_space(spark):
    each = [c for c in map(chr, range(1, 0x3100)) if c in P.SPACES]
    frame = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in [*each, "\x1c", "​", "x"]], "t string")
    for r in frame.select("t", trimmed(F.col("t")).alias("a"), trimmed_left(F.col("t")).alias("b"), F.regexp_replace("t", f"^{P.S}+|{P.S}+\\z", "").alias("plain"), F.regexp_replace("t", f"^{P.S}+", "").alias("left")).collect():
        assert r["a"] == r["plain"] and r["b"] == r["left"]


def test_has_finite_by_tokens(spark):
    r = random.Random(8)
    words = "is (is) is's isn't 'was' can. CAN cannot has, hasty -runs- x.is do the pump été ist".split()
    frame = spark.createDataFrame([(" ".join(r.choice(words) for _ in range(r.randint(0, 4))),) for _ in range(300)], "t string")
    finite = pos.MODALS + pos.BE + pos.FINITE
    by_token = F.exists(F.split("t", " "), lambda t: normal(t).isin(*finite))
    assert frame.where(has_finite(F.col("t")) != by_token).count() == 0


def test_openings_against_all_tokens(spark):
    """The pattern of first words finds what a look at every token finds."""
    r = random.Random(5)
    words = "in In IN the of order to orderly in-order a lot of_lot c a-lot é été ÉTÉ test. (test) `in order to` , \n  ".split(" ")
    frame = spark.createDataFrame([(str(i), 0, " ".join(r.choice(words) for _ in range(r.randint(0, 25)))) for i in range(200)], "file string, seg_ord int, text string")
    entries = [("in order to", (("any", ()),)), ("in", (("any", ()),)), ("the", (("any", ()),)), ("a lot of", (("any", ()),)), ("Été", (("any", ()),)), ("test", (("any", ()),)), ("order", (("any", ()),))]
    got = sorted((x["file"], x["term"], x["start"], x["end"]) for x in terms.matches(frame, lexicon.table(spark, entries)).collect())
    whole = {t: re.compile(r"(?<![\w-])" + r"\s+".join(map(re.escape, t.split(" "))) + r"(?![\w-])", re.I) for t, _ in entries}
    expected = []
    for x in frame.collect():
        code = [m.span() for m in re.finditer("`[^`]*`", x["text"])]
        for t, p in whole.items():
            expected += [(x["file"], t, *m.span()) for m in p.finditer(x["text"]) if not any(a <= m.start() and m.end() <= b for a, b in code)]
    assert got == sorted(expected) and len(got) > 100


def test_gaps_on_both_sides(spark):
    frame = spark.createDataFrame([("a1bb22",)], "t string")
    got = frame.select(located(F.col("t"), "[0-9]+", gaps=True).alias("x")).first()["x"]
    assert [(x["gap"], x["after"]) for x in got] == [("a", "bb"), ("bb", "")]


def test_kinds_of_lines_are_told_once_by_signs(spark):
    lines = ["", " 　", "```x", "~~~", "``", "# h", "#", "a # b", "- x", "| a |", "a | b", "|---|", "  1. x", "[a](b) c", "[a]( b", "\t- y"]
    frame = spark.createDataFrame([(x,) for x in lines], "raw string")
    got = [r["k"] for r in frame.select(markdown.kind(F.col("raw")).alias("k")).collect()]
    assert got == ["B", "B", "F", "F", "X", "H", "X", "X", "L", "T", "X", "B", "L", "X", "X", "L"]


def test_arguments_are_not_guessed():
    with pytest.raises(ValueError):
        parser().parse_args(["--stri"])


def test_counters_of_results():
    told = results_file([("a", None), ("b", "wrong")], "x.trx")
    assert '<Counters total="2" executed="2" passed="1" failed="1" />' in told
