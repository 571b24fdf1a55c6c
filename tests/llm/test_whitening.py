import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quillframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def exact(vectors):
    """Sums, and covariance and deviations as fractions, from whole numbers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    y = [[n * r[k] - s[k] for k in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    return n, y, cov, [sum(v * v for v in r) for r in y]


def compare(rows, got, count=32):
    n, y, cov, deviations = exact([v for _, v in rows])
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    own = {}
    for r in got:
        own.setdefault(r["vec_id"], {})[r["component"]] = r
    for (i, _), row, dev in zip(rows, y, deviations):
        assert set(own[i]) == set(range(1, min(count, len(row)) + 1))
        for k, r in own[i].items():
            assert (r["n"], r["deviation"]) == (n, dev)
            expected = float(np.array(row, float) / n @ vectors[:, k - 1]) / math.sqrt(values[k - 1])
            assert abs(abs(r["whitened"]) - abs(expected)) < 1e-8
            assert abs(r["explained"] - values[k - 1] / float(sum(cov[j][j] for j in range(len(row))))) < 1e-12
            assert 0 <= r["identity_error"] < 1e-8


def vectors(seed, n, d, spread=1.0):
    r = np.random.default_rng(seed)
    return [(i, v.tolist()) for i, v in enumerate((r.normal(size=(n, d)) * np.linspace(spread, 0.1 * spread, d)).astype(np.float32))]


@pytest.mark.parametrize("n, d, spread", [(300, 40, 1.0), (50, 5, 1000.0), (70, 3, 1e12)])
def test_against_exact_arithmetic(spark, n, d, spread):
    rows = vectors(n, n, d, spread)
    got = whitening.components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    if spread > 1e9:  # the exact squares are beyond a long
        assert all(r["deviation"] is None for r in got)
        deviations = exact([v for _, v in rows])[3]
        some = whitening.remaining(spark.createDataFrame(rows, SCHEMA))
        assert {r["vec_id"]: int(r["deviation"]) for r in whitening.whitened(some, whitening.fit(some)).collect()} == dict(enumerate(deviations))
    else:
        compare(rows, got)


def test_whitened_covariance_is_the_identity(spark):
    got = whitening.components(spark.createDataFrame(vectors(3, 400, 12), SCHEMA)).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(got.T @ got / len(got) - np.eye(12)).max() < 1e-9 and np.abs(got.mean(0)).max() < 1e-9


@pytest.mark.parametrize("bound, limbs", [(1 << 15, 1), (1 << 30, 2), (1 << 61, 4), (1 << 100, 6)])
def test_products_are_exact(bound, limbs):
    r = random.Random(bound)
    y = np.array([[r.randint(-bound, bound) for _ in range(5)] for _ in range(whitening.ROWS)] + [[bound, -bound, 0, -1, 1]], object)
    blocks = [b if bound > 1 << 62 else b.astype(np.int64) for b in (y[: whitening.ROWS], y[whitening.ROWS :])]
    got = sum((m << (whitening.BITS * w)) for w, m in enumerate(whitening.products(iter(blocks), limbs)))
    assert (got == y.T @ y).all()


def test_what_remains(spark):
    good = vectors(9, 40, 4)
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan")] * 4), (103, [1.0, 2.0, float("-inf"), 3.0]), (104, []), (105, [1.0])]
    rows = [*good, *bad, (None, [9.0, 1.0, 2.0, 3.0]), (0, good[0][1])]
    clash = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", vector int, n int")
    got = whitening.components(clash).collect()
    kept = [*good, (None, [9.0, 1.0, 2.0, 3.0]), (0, good[0][1])]
    n, _, _, deviations = exact([v for _, v in kept])
    assert len(got) == 4 * len(kept) and {(r["vec_id"], r["deviation"]) for r in got} == {(i, d) for (i, _), d in zip(kept, deviations)} and got[0]["n"] == n


def test_nothing_to_scale(spark):
    table = lambda rows: whitening.components(spark.createDataFrame(rows, SCHEMA))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])] * 3):
        assert table(rows).columns == names and table(rows).count() == 0
    flat = table([(i, [float(i), 5.0, -2.0 * i]) for i in range(6)]).collect()  # one direction alone has a variance
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, sf, "embeddings").collect()]
    compare(rows, queries.op11_embedding_whitening(spark, sf).collect())
