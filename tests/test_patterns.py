"""Every pattern takes about linear time, on texts made to be hard for it."""

import time

import pytest
from pyspark.sql import functions as F

from quillframe.functions import patterns as P
from quillframe.operators.markdown import cleaned, heading, kind, piece, segments

N = 20_000
HARD = {
    "heading": "# a" + " " * N + "b", "closed heading": "# a" + " #" * N + "b", "item": "- " + " " * N + "x", "number": "1" * N + " a", "rule": "|--" + " " * N + "x", "rules": "|" + "--|" * N + "x", "dashes": "-" * N + "x",
    "open brackets": "[" * N + "](", "links": "[a](" * N, "closed once": "[a](" * N + ")", "brackets": "[a]" * N + "](x)", "mixed": "[[](" * N + ")[", "ticks": "` " * N, "parentheses": "(" * N, "quotes": '" ' * N, "table": "|`" * N,
    "spaces": "a. " + " " * N + "b", "digits": "9." * N, "units": "9 " * N, "capitals": "A " * N, "been": "is been " * N, "has": "has " * N, "would": "would have " * N, "apostrophes": "it's'" * N, "hyphens": "a-" * N, "word": "is " + "e" * N, "words": "ed " * N, "ing": "ing-" * N + "x", "plain": "word " * N, "space": " " * N, "tab": "\t" * N + "|", "fence": " " * N + "``",
}
PATTERNS = ("FENCE", "BLANK", "HEADING", "LIST_ITEM", "NESTED_ITEM", "TABLE_ROW", "TABLE_RULE", "TABLE_CELL", "LINK", "CODE", "SENTENCE_END", "QUOTED", "PARENTHESES", "NUMBER_UNIT", "TITLE_RUN", "CONTRACTION", "PASSIVE", "COMPLEX_VERB", "ING_FORM", "TERM_TOKEN")


@pytest.mark.parametrize("name", PATTERNS)
def test_linear(spark, name):
    pattern, slow = spark._jvm.java.util.regex.Pattern.compile(getattr(P, name)), {}
    for what, text in HARD.items():
        if name == "LINK":  # as the operator reads it
            text = text[: text.rfind(")") + 1]
        took = []
        for part in (text[: len(text) // 4] + text[-3:], text):
            began = time.perf_counter()
            pattern.matcher(part).replaceAll("")
            took.append(time.perf_counter() - began)
        if took[1] > 0.3 and took[1] > 8 * took[0]:
            slow[what] = took
    assert not slow


def test_whole_documents(spark, docs):
    began = time.time()
    segments(docs(*("Text.\n" + t + "\nmore" for t in HARD.values()))).count()
    assert time.time() - began < 60


@pytest.mark.parametrize(
    "line, text",
    [("# a  ##  ", "a"), ("# a ## b", "a ## b"), ("#  #", ""), ("## ", ""), ("# #a#", "#a"), ("###### x # #", "x #"), ("#  x # ", "x"), ("   # x", "x")],
)
def test_headings(spark, line, text):
    row = spark.range(1).select(kind(F.lit(line)).alias("k"), heading(F.lit(line)).alias("t"), piece(F.lit(line), F.lit("H")).alias("p")).first()
    assert (row["k"], row["t"], row["p"]) == ("H", text, text)


def test_links_against_a_plain_reading(spark):
    """As a pattern that looks at every place does it."""
    import random
    import re

    r = random.Random(2)
    lines = ["".join(r.choice(["[", "]", "(", ")", "a", " ", "](", "!"]) for _ in range(r.randrange(14))) for _ in range(3000)]
    got = [x["c"] for x in spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", cleaned(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", t) for t in lines]


def test_ing_forms_against_a_plain_pattern(spark):
    import random

    r = random.Random(3)
    every = spark._jvm.java.util.regex.Pattern.compile(f"(?iu){P.OPENS}[a-z][a-z-]{{2,}}ing{P.CLOSES}")
    own = spark._jvm.java.util.regex.Pattern.compile(P.ING_FORM)
    for _ in range(1500):
        text = "".join(r.choice(["ing", "a", "-", "-", "b", "3", " ", "é", "King", "_"]) for _ in range(r.randrange(16)))
        assert own.matcher(text).replaceAll("<$0>") == every.matcher(text).replaceAll("<$0>"), text
