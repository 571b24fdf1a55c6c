"""A cleaning pipeline over ``documents``: quality, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns whole rows of ``documents``; the last returns packed pieces. Between
stages the rows are written and read again.

In every stage an empty table stays empty, null ids are rows like others, and
columns other than those it names, null or not, come through as they are. Null
and wordless texts go in the first stage; a later one that is called with them
keeps them, as they repeat nothing and hold nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import decontaminate, linededup, ngram_join, packing, quality
from quillframe.llm.common import fresh, settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go. Rows that repeat are judged alike."""
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier line go, and with them a document that has no word left; n_chars follows the text. Rows are told apart by id and text, and null ids come last."""
    out = linededup.deduplicated(docs)
    touched = F.col(out.columns[-1]) > 0
    left = out.where(~touched | F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    return left.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest id stays; of rows that repeat id and text, one."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go; others lose the words in such windows, and n_chars follows. A text decides, whatever its id."""
    before, = fresh(docs, "before")
    out = decontaminate.decontaminated(docs.withColumn(before, F.length("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.when(F.length("text") < F.col(before), F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(before)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 2048 ids. A null or empty text is the single id 0; rows that repeat are packed each."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules and tokenisers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
