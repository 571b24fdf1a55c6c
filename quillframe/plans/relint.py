"""Linting again: only files that changed are linted, and the table is that of a full run.

A ledger of each run has every file with the hash of its content and settings, and
the run that linted it. A new run joins files and the last ledger by file and hash; what
has no partner is linted. A run exists once its ledger is written, which is last, so a run that
was cut leaves nothing that is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.config import Config
from .lint import lint


def runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs that were finished."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger/run=*/_SUCCESS")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(int(f.getPath().getParent().getName().removeprefix("run=")) for f in found or ())


def _marked(docs: DataFrame, config: Config, dictionary: DataFrame | None) -> DataFrame:
    """Adds hash: of a file's content and of all that its findings depend on."""
    words = dictionary.agg(F.sum(F.xxhash64(*dictionary.columns).cast("decimal(38,0)")).alias("h")).first()["h"] if dictionary is not None else ""
    return docs.select("file", "content", F.sha2(F.concat_ws("\0", F.lit(f"{config!r} {words}"), F.coalesce("content", F.lit("\0"))), 256).alias("hash"))


def relint(docs: DataFrame, path: str, config: Config | None = None, dictionary: DataFrame | None = None) -> int:
    """Lint what changed in (file, content) since the last run on ``path``; the number of this run. Files are told apart by their names."""
    spark, config = docs.sparkSession, config or Config()
    done = runs(spark, path)
    number = done[-1] + 1 if done else 1
    marked = _marked(docs, config, dictionary)
    before = spark.read.parquet(f"{path}/ledger/run={done[-1]}") if done else spark.createDataFrame([], "file string, hash string, run int")
    known = marked.select("file", "hash").join(before, ["file", "hash"])
    changed = marked.join(before, ["file", "hash"], "left_anti")
    lint(changed.select("file", "content"), config, dictionary).write.mode("overwrite").parquet(f"{path}/findings/run={number}")
    ledger = known.select("file", "hash", "run").unionByName(changed.select("file", "hash", F.lit(number).alias("run")))
    ledger.write.mode("overwrite").parquet(f"{path}/ledger/run={number}")
    return number


def current(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostics of the files of the last run, whichever run linted them."""
    last = runs(spark, path)[-1]
    ledger = spark.read.parquet(f"{path}/ledger/run={last}").select("file", "run")
    found = spark.read.option("basePath", f"{path}/findings").parquet(f"{path}/findings")
    return found.join(ledger, ["file", "run"]).drop("run")
