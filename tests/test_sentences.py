import pytest
from pyspark.sql import functions as F

from quillframe.functions.text import located, running_sum
from quillframe.operators.sentences import sentences

CASES = [
    ("Rain fell. Snow melted.", [("Rain fell.", 2, 0), ("Snow melted.", 2, 11)]),
    ("Bring these tools: Lift the lid.", [("Bring these tools:", 3, 0), ("Lift the lid.", 3, 19)]),
    ("Paint a wall (use our wide brush) at dawn.", [("Paint a wall (use our wide brush) at dawn.", 6, 0)]),
    ("Paint a wall (Use our wide brush.) at dawn.", [("Paint a wall (Use our wide brush.) at dawn.", 6, 0), ("Use our wide brush.", 4, 14)]),
    ("A rain-soaked coat dries.", [("A rain-soaked coat dries.", 4, 0)]),
    ("Heat an oven to 90 C before lunch.", [("Heat an oven to 90 C before lunch.", 7, 0)]),
    ('Press our "Night Mode" key.', [('Press our "Night Mode" key.', 4, 0)]),
    ("Ask the Blue River Sailing Club today.", [("Ask the Blue River Sailing Club today.", 4, 0)]),
    ("Type `make all --jobs 4` there.", [("Type `make all --jobs 4` there.", 3, 0)]),
    ("Run `a` (b) now.", [("Run `a` (b) now.", 3, 0)]),
    ("  Lead. Then  ", [("Lead.", 1, 2), ("Then", 1, 8)]),
    ("   ", []),
    ("", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", sentences(F.col("t")).alias("s"))
    return {r["i"]: [tuple(x) for x in r["s"]] for r in rows.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_sentences(found, i):
    assert found[i] == CASES[i][1]


def test_running_sum(spark):
    rows = spark.createDataFrame([([],), ([3],), (list(range(300)),)], "v array<int>").select("v", running_sum(F.col("v")).alias("s")).collect()
    for r in rows:
        assert r["s"] == [sum(r["v"][: k + 1]) for k in range(len(r["v"]))]


def test_located(spark):
    row = spark.createDataFrame([("é ab 😀 abab",)], "t string").select(located(F.col("t"), "ab").alias("m")).first()
    assert [(m["start"], m["end"], m["value"]) for m in row["m"]] == [(2, 4, "ab"), (7, 9, "ab"), (9, 11, "ab")]
