"""What the operators of this folder share: scratch tables, hashing, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import pickle
import re
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["quillframe"])


def share(spark: SparkSession, value) -> Callable[[], Any]:
    """Broadcasts a value; tasks get it by calling what this returns. Objects of this package travel by value, like functions."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


#: Stand-in folders, by application.
_OWN: dict[str, str] = {}
#: Scratch folders written so far, by application, and those of the ``settled`` calls that run now.
_WRITTEN: dict[str, set[str]] = {}
_SCOPES: list[set[str]] = []
#: Where kept tables lie, by the id of the object; the object itself tells whether it is still that one.
_PLACES: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``), with its scheme.

    Where the session names none, a temporary folder stands in for it on a local master; on a cluster that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _OWN.get(context.applicationId) or tempfile.mkdtemp(prefix="quillframe-")
        _OWN[context.applicationId] = root
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1).rstrip("/") if re.match("file:/[^/]", whole) else whole.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillframe/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = set()
        atexit.register(_at_end, spark, app)
    for paths in (_WRITTEN[app], *_SCOPES):
        paths.add(path)
    return path


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors. ``options`` are the writer's."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = weakref.ref(out), path
    return out


def forget(*kept: DataFrame) -> None:
    """Remove tables that ``keep`` gave, once all that is made from them is written, and the shuffle files on the way."""
    for df in kept:
        ref, path = _PLACES.pop(id(df), (None, None))
        if ref and ref() is df:
            _remove(df.sparkSession, {path})
    if kept:
        release(kept[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs whose results are written. Its cleaner acts when the driver's garbage is collected, which else may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, paths: set[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    for held in (_WRITTEN.get(context.applicationId, set()), *_SCOPES):
        held -= paths


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``keep`` of what ``build`` gives, after which the tables that were written on the way to it are removed."""
    _SCOPES.append(on_the_way := set())
    try:
        made = build()
    finally:
        _SCOPES.remove(on_the_way)
    out = keep(made, name)
    _remove(spark, on_the_way)
    return out


def clear(spark: SparkSession) -> None:
    """Remove all scratch tables of this application. What reads them must have been written; at the end of the program it is done by itself."""
    _remove(spark, set(_WRITTEN.get(spark.sparkContext.applicationId, ())))


def _at_end(spark: SparkSession, app: str) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped
        if spark.sparkContext.applicationId == app:
            clear(spark)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where columns of ``df`` have them already, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_under(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows, read no further than needed."""
    return df.limit(limit + 1).count() <= limit


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast when the table is known to have at most ``limit`` rows and ``BROADCAST_BYTES``; else leave the join to Spark."""
    fixed = 24 + 8 * len(df.columns)
    if not rows_under(df, min(limit, BROADCAST_BYTES // fixed)):
        return df
    loose = [F.octet_length(c) if kind in ("string", "binary") else 24 * F.size(c) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith("array")]
    if loose:
        total = df.agg(F.sum(sum((F.coalesce(x, F.lit(0)) for x in loose), F.lit(fixed))).alias("n")).first()["n"]
        if (total or 0) > BROADCAST_BYTES:
            return df
    return F.broadcast(df)


def crc_mod(col, mod: int):
    """crc32 of an id's decimal text, modulo ``mod``; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered; cleared when it has grown large."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def many(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives memory back when its task ends: workers stay, one beside the other, for later tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: Rows and bytes of a batch handled at once in a task.
SLICE_ROWS, SLICE_BYTES = 2_000, 4 << 20


def by_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, whole: bool = False) -> DataFrame:
    """mapInArrow with a function made once per task; it returns columns (arrays or lists) for each slice of a batch, or ``whole`` batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            n = batch.num_rows
            size = n if whole else max(1, min(SLICE_ROWS, n * SLICE_BYTES // max(1, batch.nbytes)))
            for start in range(0, n, size or 1):
                if (out := step(batch.slice(start, size))) is not None:
                    yield pa.RecordBatch.from_arrays([_arrow(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(tidy(run), schema)


def _arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, kind)


def list_array(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    """A list column from one numpy array a row."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    flat = flat.view(kind) if flat.dtype.itemsize == np.dtype(kind).itemsize else flat.astype(kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def groups_of(batches: Iterator[pa.RecordBatch], key: str, of: Callable[[np.ndarray], np.ndarray] = lambda v: v) -> Iterator[pa.Table]:
    """Runs of batches of a partition sorted by ``key``, cut so that no key is split between two of them; ``of`` maps the column to keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = of(batch.column(key).to_numpy(zero_copy_only=False))
        start = int(np.searchsorted(keys, keys[-1], "left"))
        if held and (start or last != keys[0]):
            if start:
                same = int(np.searchsorted(keys, last, "right")) if keys[0] == last else 0
                yield pa.Table.from_batches([*held, batch.slice(0, same)])
                batch, start = batch.slice(same), start - same
            else:
                yield pa.Table.from_batches(held)
            held = []
        if start:
            yield pa.Table.from_batches([batch.slice(0, start)])
        held.append(batch.slice(start))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, comp): comp is the smallest node reached.

    Alternates the large-star and small-star steps until nothing moves. Each
    round is written to the shared folder. A node's many neighbours are folded
    by partial minima, and its rows are joined back, never gathered.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = _sign(now)
    while sign[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = keep(star.where("a <> b").distinct(), "edges")
        if (new := _sign(now)) == sign:
            break
        sign = new
    pairs = now.groupBy("a").agg(F.min("b").alias("comp"))
    return pairs.select(F.col("a").alias("node"), "comp").union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]
