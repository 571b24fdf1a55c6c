"""Whitening of embeddings with exact sums: digit-slice matrix products.

Entries become integers x. Their covariance is taken from y = n*x - S, which is
centred and whole, so nothing is lost before the products: each y is cut into
limbs of ``BITS`` bits, whose products, summed over ``ROWS`` rows, stay below 2^53, so
float64 BLAS has them exactly. Sums of one weight are merged in Spark as
decimals and put together as big integers on the driver, a table of
d x d sums at any number of rows. Division by n^3 is the only rounding before the
eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, tidy

#: x = floor(STEPS * entry) + SHIFT. Fixed values.
STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Bits of a limb and rows of a block: 2 * BITS + log2(ROWS) is at most 53.
BITS, ROWS = 20, 4096
#: Whole numbers up to this are kept in 64 bits; larger ones as Python's.
_WORD = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """A fit: rows, sums of each dimension, bound of all |n*x - S|, unit eigenvectors (columns, falling), their eigenvalues, shares of the trace, and how far the whitened covariance is from the identity."""

    n: int
    sums: tuple[int, ...]
    bound: int
    vectors: np.ndarray
    values: np.ndarray
    explained: tuple[float, ...]
    identity_error: float | None = None

    @property
    def axes(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def remaining(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that have one: not null, all entries finite, and as long as most are (of two lengths equally frequent the larger)."""
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))
    some = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    some = some.where(F.col("vector").isNotNull() & F.forall("vector", finite))
    usual = some.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return some.where(F.size("vector") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """x of a block of vectors, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    scaled = np.floor(STEPS * flat.reshape(len(column), -1))
    if scaled.size and max(abs(scaled.min()), abs(scaled.max())) >= _WORD >> 1:
        whole = np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) if np.isfinite(v) else (1 << 63) - 1 if v > 0 else -(1 << 63) for v in scaled.ravel()], object).reshape(scaled.shape)
        return whole + SHIFT
    return scaled.astype(np.int64) + SHIFT


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...], bound: int) -> np.ndarray:
    """n*x - S, exactly: in 64 bits where the bound allows it. The mean is taken off first, so that nothing larger comes between."""
    middle = [s // n for s in sums]
    rest = [s - m * n for s, m in zip(sums, middle)]
    if bound < _WORD and x.dtype != object:
        return (x - np.array(middle, np.int64)) * n - np.array(rest, np.int64)
    return (x.astype(object) - np.array(middle, object)) * n - np.array(rest, object)


def _limbs(y: np.ndarray, count: int) -> list[np.ndarray]:
    """Limbs of ``BITS`` bits, the last with the sign, as float64."""
    out = [((y >> (BITS * k)) & ((1 << BITS) - 1)).astype(np.float64) for k in range(count - 1)]
    return [*out, (y >> (BITS * (count - 1))).astype(np.float64)]


def products(blocks: Iterator[np.ndarray], limbs: int) -> list[np.ndarray]:
    """Of whole rows y: for each weight w the matrix of which sum(2^(BITS*w) * matrix) is the sum of all y y^T; big integers."""
    total = None
    for y in blocks:
        parts = _limbs(y, limbs)
        d = y.shape[1]
        if total is None:
            total = [np.zeros((d, d), object) for _ in range(2 * limbs - 1)]
        for i, left in enumerate(parts):
            for j in range(i, limbs):
                exact = (left.T @ parts[j]).astype(np.int64)
                total[i + j] += (exact if i == j else exact + exact.T).astype(object)
    return total or []


def _summed(rows: DataFrame, run: Callable[[Iterator[np.ndarray]], Iterator[tuple]], schema: str, keys: list[str], kind: str) -> list:
    """Sums by key of what each task makes of its blocks of x; a task gives a row for each key, and Spark adds them up."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "decimal(38,0)": pa.decimal128(38, 0), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (_matrix(b.column(0).slice(k, ROWS)) for b in batches for k in range(0, b.num_rows, ROWS))
        got = list(run(blocks))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types)], names=names)

    values = [c for c in names if c not in keys]
    sums = {"s": F.sum("s").cast(kind), "lo": F.min("lo"), "hi": F.max("hi"), "n": F.sum("n").cast(kind)}
    return rows.select("vector").mapInArrow(tidy(task), schema).groupBy(*keys).agg(*(sums[c].alias(c) for c in values)).orderBy(*keys).collect()


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from all of ``remaining`` rows; None where there are none, or none that differ.

    Reads the rows three times: for sums, for products, and to measure the whitened covariance. Components whose
    eigenvalue is nought to double precision are left out, as they cannot be scaled.
    """
    whole = "decimal(38,0)"

    def sums(blocks: Iterator[np.ndarray]) -> Iterator[tuple]:
        n, s, lo, hi = 0, None, None, None
        for x in blocks:
            total = x.astype(object).sum(0) if x.dtype == object else x.sum(0).astype(object) if np.abs(x).max(initial=0) < _WORD // ROWS else x.astype(object).sum(0)
            s, n = (total if s is None else s + total), n + len(x)
            lo, hi = (x.min(0), x.max(0)) if lo is None else (np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0)))
        if s is not None:
            yield from ((k, Decimal(n), Decimal(int(v)), Decimal(int(a)), Decimal(int(b))) for k, (v, a, b) in enumerate(zip(s, lo, hi)))

    got = _summed(rows, sums, f"dim int, n {whole}, s {whole}, lo {whole}, hi {whole}", ["dim"], whole)
    if not got:
        return None
    n, total = int(got[0]["n"]), tuple(int(r["s"]) for r in got)
    bound = max(max(n * int(r["hi"]) - int(r["s"]), int(r["s"]) - n * int(r["lo"])) for r in got)
    limbs = max(1, -(-(bound.bit_length() + 1) // BITS))

    def cross(blocks: Iterator[np.ndarray]) -> Iterator[tuple]:
        for w, m in enumerate(products((_centred(x, n, total, bound) for x in blocks), limbs)):
            yield from ((i, j, w, Decimal(int(m[i, j]))) for i in range(len(m)) for j in range(i, len(m)))

    gram = np.zeros((len(total), len(total)), object)
    for r in _summed(rows, cross, f"i int, j int, w int, s {whole}", ["i", "j", "w"], whole):
        gram[r["i"], r["j"]] += int(r["s"]) << (BITS * r["w"])
    gram = np.triu(gram) + np.triu(gram, 1).T
    trace = sum(gram[k, k] for k in range(len(gram)))
    if not trace:
        return None
    cube = n**3
    covariance = np.array([[v / cube for v in row] for row in gram], np.float64)  # whole numbers divide with one rounding
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > len(values) * np.finfo(np.float64).eps * values.max()][:components]
    shares = tuple(float(v / (trace / cube)) for v in values[order])
    found = Whitening(n, total, bound, np.ascontiguousarray(vectors[:, order]), values[order], shares)

    def second(blocks: Iterator[np.ndarray]) -> Iterator[tuple]:
        s, k = 0.0, 0
        for x in blocks:
            w = np.column_stack([np.ones(len(x)), project(x, found)])
            s, k = s + w.T @ w, w.shape[1]
        yield from ((i, j, float(s[i, j])) for i in range(k) for j in range(i, k))

    moments = np.zeros((len(order) + 1, len(order) + 1))
    for r in _summed(rows, second, "i int, j int, s double", ["i", "j"], "double"):
        moments[r["i"], r["j"]] = moments[r["j"], r["i"]] = r["s"] / n
    off = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) - np.eye(len(order))
    return Whitening(n, total, bound, found.vectors, found.values, shares, float(np.abs(off).max()))


def project(x: np.ndarray, found: Whitening) -> np.ndarray:
    """Whitened rows."""
    return (_centred(x, found.n, found.sums, found.bound).astype(np.float64) / found.n) @ found.axes


def whitened(rows: DataFrame, found: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array<double>): for each of ``remaining`` rows the exact sum over dimensions of (n*x - S)^2, and the row on all components."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            x = _matrix(batch.column(1))
            y = _centred(x, found.n, found.sums, found.bound)
            square = y.astype(object) if y.dtype == object or found.bound**2 * y.shape[1] >= _WORD else y
            flat = project(x, found)
            ends = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
            deviations = [Decimal(int(v)) for v in (square * square).sum(1)]
            return {"vec_id": batch.column(0), "deviation": pa.array(deviations, pa.decimal128(38, 0)), "whitened": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))}

        return step

    return by_batches(rows.select("vec_id", "vector"), make, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def components(rows: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, holds a null or an entry that is not finite, or is not as long as most, are left out, null ids are not;
    repeated rows count each. An entry whose x passes the range of a long counts as its end, and a deviation that
    no long holds is null (``whitened`` has it as a decimal). Where no two rows differ, or the table is empty, there are no
    components and so no rows. Other columns are not read.
    """
    some = remaining(rows, id_col, vector_col)
    found = fit(some, count)
    if found is None:
        kind = some.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    each = whitened(some, found).select("vec_id", F.posexplode("whitened").alias("k", "whitened"), F.expr("try_cast(deviation as long)").alias("deviation"))
    share = F.get(F.array(*map(F.lit, found.explained)), F.col("k"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(found.identity_error).alias("identity_error"))
