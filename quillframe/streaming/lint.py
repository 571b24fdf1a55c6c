"""Diagnostics of a stream of documents, which need no state, as a finding depends on one document alone; and running counts, of which the last version of a file is a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import report
from ..plans.lint import diagnostics, findings
from ..sources.config import Config


def lint_stream(docs: DataFrame, config: Config | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """Streaming diagnostics of a streaming (file, content); the dictionary is a static table."""
    return diagnostics(findings(docs, config, dictionary))


def lint_to(docs: DataFrame, path: str, checkpoint: str, config: Config | None = None, dictionary: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Append diagnostics as Parquet, exactly once by the sink's own log."""
    return lint_stream(docs, config, dictionary).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def count_to(docs: DataFrame, path: str, checkpoint: str, config: Config | None = None, dictionary: DataFrame | None = None, version: str | None = None, **trigger) -> StreamingQuery:
    """Keep errors and warnings by file of a streaming (file, content), as a table at ``path`` that ``latest`` and ``totals`` read.

    A file may come again: its last version counts alone, in a batch the one with the largest ``version`` (a column), of equal ones any. A
    batch writes its own folder, over what an earlier attempt of it left, so every batch counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = Window.partitionBy("file").orderBy(F.col(version).desc() if version else F.lit(0), F.xxhash64("content"))
        own = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("file", "content").persist()
        try:
            report.by_file(own, findings(own, config, dictionary)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            own.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(file, errors, warnings) of the last version of each file."""
    rows = spark.read.parquet(path)
    return rows.groupBy("file").agg(F.max_by(F.struct("errors", "warnings"), "batch").alias("s")).select("file", "s.*")


def totals(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One row: files, errors, warnings, and whether the gate fails."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = latest(spark, path).agg(F.count("*").alias("files"), zero("errors").alias("errors"), zero("warnings").alias("warnings"))
    return rows.withColumn("failed", (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0)))
