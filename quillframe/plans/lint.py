"""From documents to diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markdown, rules, terms
from ..sources import config as settings
from ..sources.config import Config
from ..sources.files import read_files

ORDER = ("file", "pass", "seg_ord", "rank", "offset")
DIAGNOSTIC = ("file", "line", "column", "rule_code", "severity", "message", "suggestion")


def prepared(docs: DataFrame, config: Config) -> DataFrame:
    """Segments of (file, content) with what the settings come to for the file, worked out once a document."""
    return markdown.segments(settings.resolved(docs.select("file", "content"), config), more=("mode", "rules", "allowed", "phrases"))


def with_phrase_spans(segments: DataFrame, config: Config) -> DataFrame:
    """Adds phrase_spans: where the phrases allowed for the file stand in the segment."""
    return segments.withColumn("phrase_spans", terms.phrase_spans(settings.all_phrases(config)))


def dictionary_findings(segments: DataFrame, dictionary: DataFrame, config: Config) -> DataFrame:
    return terms.findings(terms.unless_allowed(terms.matches(with_phrase_spans(segments, config), dictionary)))


def findings(docs: DataFrame, config: Config | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """All findings with their sort keys, in one pass over the documents. Only the dictionary is broadcast; documents are never shuffled."""
    config = config or Config()
    segments = prepared(docs, config)
    if not config.dictionary.enabled:
        return rules.structural(segments)
    words = dictionary if dictionary is not None else settings.dictionary(docs.sparkSession, config)
    return terms.with_rules(rules.with_sentences(with_phrase_spans(segments, config), counted=False), terms.index(words), rules.every())


def lint(docs: DataFrame, config: Config | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """Diagnostics of (file, content): file, line, column, rule_code, severity, message, suggestion. column is always null."""
    return diagnostics(findings(docs, config, dictionary))


def diagnostics(found: DataFrame) -> DataFrame:
    return found.select("file", "line", F.lit(None).cast("int").alias("column"), "rule_code", "severity", "message", "suggestion")


def in_order(found: DataFrame) -> DataFrame:
    """Findings in the order of a report: by file, structural ones first, then as they stand."""
    return found.orderBy(*ORDER)


def lint_files(spark: SparkSession, root: str, config: Config | None = None, globs: list[str] | None = None) -> DataFrame:
    return lint(read_files(spark, root, config, globs), config)
