"""Named queries over the driver's tables, one a group of operators, each over whole tables.

The documents hold little Markdown, so most queries read them wrapped in some:
a heading, items, a table, a fenced block and paragraphs that trip the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import resolve_line
from ..operators import lexicon, line_blocks, markdown, rules, terms
from ..sources import config as settings
from ..sources.config import Config, DictionaryConfig, Profile
from . import lint, report
from .oracles import ORACLES

#: Terms that occur in the Markdown.
ENTRIES = (
    ("utilize", (("verb", ("use",)),)),
    ("impact", (("noun", ("effect",)), ("verb", ("affect",)))),
    ("prior to", (("any", ("before",)),)),
    ("in the event of", (("any", ("if",)),)),
    ("event", (("noun", ("case",)),)),
    ("a lot of", (("any", ("much", "many")),)),
    ("shall", (("verb", ("must",)),)),
    ("test", (("verb", ("TEST",)),)),
    ("the", (("any", ()),)),
    ("opened", (("verb", ("open",)), ("adjective", ("open",)))),
)
CONFIG = Config(
    profiles=[
        Profile("src1/**", mode="procedure", rules={"allow_semicolons": True}, allow=["Must"]),
        Profile("src1*/*.md", mode="descriptive", rules={"max_words_procedure": 18, "passive_voice": "off"}, allow=["shall"], allow_in_phrase=["in the event of"]),
        Profile("src1/*", rules={"passive_voice": "error"}, ignore=["api"]),
        Profile("SRC2/**", mode="procedure", rules={"max_words_procedure": 15}),
    ],
    dictionary=DictionaryConfig(allow=["API"], allow_in_phrase=["fuel mix"]),
)
TERM_ORDER = ("api", "shall", "must")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Sentences of which a document gets one, by its id.
SENTENCES = (
    "We utilize a lot of heat in the event of testing.",
    "Open valves impact the impact of an opened test; you shan't utilize them.",
    "To impact tests, Shall   we start prior  to the opening event? Opened doors test the seal.",
    "Utilize `utilize` here: test the test (The test was opened.) that has been opened. Impact 3 of them.",
)


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): every document's whole text in Markdown, whose marks and first sentences differ by id."""
    d, n = F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(60))
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    mark, fence = pick("-", "*", "+", "1.", "2)"), pick("```", "~~~~")
    parts = [
        F.repeat(F.lit("#"), (n % 6 + 1).cast("int")), " Guide for ", F.col("source"), pick("", " ##"), "\n\n", mark, " item ", d, "\n  wrapped; it isn't the pump's door\n", mark, " \n  It's `a;b` (See the note.) that's opened.\n    - nested item has been opened by 10 the team\n\n",
        "| id | note |\n| --- | :-- |\n| ", d, " | `a|b` prior to testing |\n\n", fence, "\nvar utilize = 1; isn't\n", fence, "\n\nSee the [user guide](https://example.com/", d,
        ') for the use of the tool. The Main Control Panel was opened, and "all of it" shall impact the test.\n', pick(*SENTENCES), "\n\n", F.col("text"),
    ]
    content = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return documents(spark, sf_dir).select(F.concat("source", F.lit("/"), d, F.lit(".md")).alias("file"), content.alias("content"))


def dealt(docs: DataFrame, least: int = 1_000) -> DataFrame:
    """Documents over all cores, where one task would read more than two cores' share of them.

    A row group is read by one task, however many splits Spark makes of its file, and a document takes far longer to lint than to move.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    sizes = [r["n"] for r in docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    if sum(sizes) < least or max(sizes) * cores <= 2 * sum(sizes):
        return docs
    return docs.repartition(4 * cores, "file", "content")


def _segments(spark, sf_dir) -> DataFrame:
    return markdown.segments(markdown_docs(spark, sf_dir))


def _lines(spark, sf_dir) -> DataFrame:
    rows = markdown_docs(spark, sf_dir).select("file", F.posexplode(markdown.lines(F.col("content"))).alias("i", "raw"))
    return rows.select("file", (F.col("i") + 1).alias("line_no"), "raw")


def lines(spark, sf_dir):
    return _lines(spark, sf_dir)


def fence_filter(spark, sf_dir):
    """Lines outside fenced blocks: the numbers of the lines that the coded document keeps."""
    kept = F.filter(F.split(F.regexp_replace(markdown.coded(F.col("content")), markdown._FENCED, ""), "\n", -1), lambda x: x != "")
    numbers = F.transform(kept, lambda x: F.regexp_extract(x, "^.([0-9]+)", 1).cast("int"))
    rows = markdown_docs(spark, sf_dir).select("file", markdown.lines(F.col("content")).alias("l"), F.explode(numbers).alias("line_no"))
    return rows.select("file", "line_no", F.element_at("l", F.col("line_no")).alias("raw"))


def link_rewrite(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("cleaned", markdown.cleaned(F.col("raw"))).where("cleaned <> raw").drop("raw")


def line_kinds(spark, sf_dir):
    """How many lines there are of each kind; fenced content is not counted."""
    coded = F.regexp_replace(markdown.coded(F.col("content")), r"(?dm)^(F[^\n]*\n)(?:[^F][^\n]*\n)*+(F[^\n]*\n)?", "$1$2")
    kinds = F.transform(F.filter(F.split(coded, "\n", -1), lambda x: x != ""), lambda x: F.substring(x, 1, 1))
    return markdown_docs(spark, sf_dir).select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def _of_role(role: str, *columns: str):
    return lambda spark, sf_dir: _segments(spark, sf_dir).where(F.col("role") == role).select(*columns)


def paragraph_fold(spark, sf_dir):
    rows = _segments(spark, sf_dir).where("role = 'Paragraph'")
    return rows.select("file", "seg_ord", "line", "text", F.size("line_offsets").cast("long").alias("n_lines"))


def paragraph_fold_lines(spark, sf_dir):
    """``paragraph_fold`` from rows of lines, by scans over blocks of them."""
    rows = line_blocks.segments(line_blocks.lines_of(markdown_docs(spark, sf_dir)), block=64).where("role = 'Paragraph'")
    return rows.select("file", "seg_ord", "line", "text", F.size("line_offsets").cast("long").alias("n_lines"))


def resolve_lines(spark, sf_dir):
    """The source lines of a paragraph's first and last characters."""
    rows = _segments(spark, sf_dir).where("role = 'Paragraph'")
    return rows.select("file", "seg_ord", resolve_line(F.col("line_offsets"), F.lit(0)).alias("line"), resolve_line(F.col("line_offsets"), F.length("text") - 1).alias("last_line"))


def code_spans(spark, sf_dir):
    spans = F.transform(rules.code_spans(F.col("text")), lambda x: F.col("text").substr(x["start"] + 1, x["len"]))
    return _segments(spark, sf_dir).select("file", "seg_ord", F.explode(spans).alias("code"))


def _sentences(spark, sf_dir) -> DataFrame:
    return rules.with_sentences(_segments(spark, sf_dir))


def _parts(spark, sf_dir) -> DataFrame:
    """Sentences with their place: inner ones share the place of the sentence that holds them."""
    inner = lambda s, i: F.when(i == 0, False).otherwise(F.exists(F.slice(F.col("sentences"), F.lit(1), i), lambda o: (o["start_offset"] < s["start_offset"]) & (s["start_offset"] < o["start_offset"] + F.length(o["text"]))))
    marked = F.transform("sentences", lambda s, i: F.struct(s["text"].alias("text"), s["start_offset"].alias("start_offset"), inner(s, i).alias("inner")))
    rows = _sentences(spark, sf_dir).withColumn("m", marked)
    place = F.transform("m", lambda s, i: F.struct(s["text"].alias("text"), s["start_offset"].alias("start_offset"), s["inner"].alias("inner"), F.size(F.filter(F.slice("m", F.lit(1), i + 1), lambda o: ~o["inner"])).alias("ord")))
    return rows.select("file", "seg_ord", F.explode(place).alias("s")).select("file", "seg_ord", "s.*")


def sentence_split(spark, sf_dir):
    return _parts(spark, sf_dir).where("not inner").select("file", "seg_ord", "ord", "text", "start_offset")


def parenthetical_sentences(spark, sf_dir):
    return _parts(spark, sf_dir).where("inner").select("file", "seg_ord", "ord", "text")


def word_count(spark, sf_dir):
    return _sentences(spark, sf_dir).select("file", "seg_ord", F.explode("sentences").alias("s")).select("file", "seg_ord", "s.text", "s.word_count")


def _structural(spark, sf_dir, *names: str, config: Config | None = None) -> DataFrame:
    return rules.structural(lint.prepared(markdown_docs(spark, sf_dir), config or Config()), *names)


def rule_word_limit(spark, sf_dir):
    return _structural(spark, sf_dir, "word_limit").select("file", "seg_ord", "message")


def _placed(name: str):
    return lambda spark, sf_dir: _structural(spark, sf_dir, name).select("file", "seg_ord", "line", "offset", "message", "suggestion")


def _quoted(name: str):
    return lambda spark, sf_dir: _structural(spark, sf_dir, name).select("file", "seg_ord", F.regexp_extract("message", r'(?s): "(.*)"\z', 1).alias("sentence"))


def rule_contraction(spark, sf_dir):
    return _structural(spark, sf_dir, "contraction").select("file", "seg_ord", F.regexp_extract("message", "'(.*)' is not", 1).alias("match"))


def rule_paragraph_length(spark, sf_dir):
    return _structural(spark, sf_dir, "paragraph_length").select("file", "seg_ord", "line", "message")


def _words(spark, sf_dir, name: str, pattern: str = "[a-z]{5,}", least: int = 1) -> DataFrame:
    """(w, n): the words of a table's texts in lower case, and how often each occurs."""
    texts = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({pattern})"), F.lit(1))).alias("w"))
    return texts.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _layered(spark, sf_dir) -> DataFrame:
    """A dictionary in three layers, of the words of the benchmark, of conversations and of documents, which differ in case."""

    def layer(name, term, pos, least):
        sense = F.struct(F.lit(pos).alias("pos"), F.array(F.col("n").cast("string")).alias("alternatives"), F.lit(None).cast("string").alias("note"))
        return _words(spark, sf_dir, name, least=least).select(term.alias("term"), F.array(sense).cast(lexicon.SENSES).alias("senses"))

    w = F.col("w")
    layers = layer("benchmark", w, "any", 1), layer("conversations", F.initcap(w), "noun", 3), layer("documents", F.upper(w), "verb", 20)
    return lexicon.merged(*layers, removed=("THERE", "which"))


def dict_merge(spark, sf_dir):
    return _layered(spark, sf_dir).select("term", F.explode("senses").alias("s")).select("term", "s.pos", F.array_join("s.alternatives", ", ").alias("alternatives"))


def _hits(spark, sf_dir, config: Config) -> DataFrame:
    segments = lint.prepared(markdown_docs(spark, sf_dir), config)
    return terms.matches(lint.with_phrase_spans(segments, config), lexicon.table(spark, ENTRIES))


def dict_match(spark, sf_dir):
    return _hits(spark, sf_dir, Config()).groupBy("file", "seg_ord", "term").agg(F.count("*").alias("n"))


def dict_match_large(spark, sf_dir):
    """Places of all words and pairs of words of the benchmark, as a dictionary that is joined."""
    pairs = _words(spark, sf_dir, "benchmark", "[a-z]{5,} [a-z]{5,}").where(F.split("w", " ")[0] != F.split("w", " ")[1])
    words = _words(spark, sf_dir, "benchmark").union(pairs).select(F.col("w").alias("term"), F.expr(f"cast(array() as {lexicon.SENSES})").alias("senses"))
    return terms.matches(_segments(spark, sf_dir), words, most=0).groupBy("term").agg(F.count("*").alias("n"))


def dict_file_allow(spark, sf_dir):
    config = Config(profiles=[Profile("src1/*", allow=["Shall"]), Profile("src2/*", ignore=["shall"])], dictionary=DictionaryConfig(ignore=["THE"]))
    return terms.unless_allowed(_hits(spark, sf_dir, config)).groupBy("term").agg(F.count("*").alias("n"))


def dict_phrase_allow(spark, sf_dir):
    config = Config(profiles=[Profile("src1*/**", allow_in_phrase=["the event of", "utilize a lot of heat"])])
    kept = terms.unless_allowed(_hits(spark, sf_dir, config)).where(F.col("term").isin("event", "in the event of", "a lot of"))
    return kept.groupBy("term").agg(F.count("*").alias("n"))


def pos_guess(spark, sf_dir):
    rows = terms.judged(_hits(spark, sf_dir, CONFIG))
    return rows.select("file", "seg_ord", "start", "term", F.coalesce("pos", F.lit("?")).alias("pos"))


def sense_select(spark, sf_dir):
    rows = terms.judged(_hits(spark, sf_dir, CONFIG))
    return rows.select("file", "seg_ord", "start", "term", F.size("left").alias("n_left"), terms.reported(F.col("pos"), F.col("left")).alias("reported"))


def dict_message(spark, sf_dir):
    segments = lint.prepared(markdown_docs(spark, sf_dir), CONFIG)
    return lint.dictionary_findings(segments, lexicon.table(spark, ENTRIES), CONFIG).select("file", "line", "message", "suggestion")


def _resolved(spark, sf_dir) -> DataFrame:
    return settings.resolved(markdown_docs(spark, sf_dir), CONFIG)


def profile_mode(spark, sf_dir):
    return _resolved(spark, sf_dir).select("file", "mode")


def profile_rules(spark, sf_dir):
    return _resolved(spark, sf_dir).select("file", "rules.max_words_procedure", "rules.max_words_descriptive", "rules.allow_semicolons", "rules.passive_voice")


def profile_terms(spark, sf_dir):
    return _resolved(spark, sf_dir).select("file", F.array_join(F.filter(F.array(*map(F.lit, TERM_ORDER)), lambda t: F.array_contains("allowed", t)), ",").alias("terms"))


def profile_phrases(spark, sf_dir):
    return _resolved(spark, sf_dir).select("file", F.array_join("phrases", ",").alias("phrases"))


def summary_counts(spark, sf_dir):
    return report.by_rule(_structural(spark, sf_dir))


def summary_by_file(spark, sf_dir):
    return report.by_file(markdown_docs(spark, sf_dir), _structural(spark, sf_dir))


def gate_exit(spark, sf_dir):
    """Whether the gate fails in strict runs and in others."""
    return report.gate(lint.prepared(dealt(markdown_docs(spark, sf_dir)), Config()))


def _found(spark, sf_dir) -> DataFrame:
    return lint.findings(dealt(markdown_docs(spark, sf_dir)), CONFIG, lexicon.table(spark, ENTRIES))


def report_text(spark, sf_dir):
    """The text report of all findings."""
    return lint.diagnostics(_found(spark, sf_dir)).select(report.text_line().alias("report"))


def report_json(spark, sf_dir):
    """The JSON report of all findings: the counts, then a row a finding."""
    return report.json_rows(markdown_docs(spark, sf_dir), _found(spark, sf_dir))


def finding_order(spark, sf_dir):
    """The place of each finding in the report of its file."""
    place = F.row_number().over(Window.partitionBy("file").orderBy(*lint.ORDER[1:]))
    return _found(spark, sf_dir).select("file", place.alias("place"), "rule_code", "message")


def dict_lookup(spark, sf_dir):
    """Entries asked for in any case: for each word of the conversations as it is written."""
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{5,})"), F.lit(1))).alias("asked")).distinct()
    found = lexicon.lookups(_layered(spark, sf_dir), texts).select("asked", F.explode("senses").alias("s"))
    return found.select("asked", "s.pos", F.array_join("s.alternatives", ", ").alias("alternatives"))


def label_summary(spark, sf_dir):
    """Findings by the labels of their documents."""
    found = _structural(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n"))
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    named = labelled.withColumn("file", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))
    return named.join(found, "file", "left").groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


def full_lint(spark, sf_dir):
    return lint.diagnostics(_found(spark, sf_dir))


QUERIES = {
    "lines": lines,
    "fence_filter": fence_filter,
    "link_rewrite": link_rewrite,
    "line_kinds": line_kinds,
    "headings": _of_role("Heading", "file", "line", "text"),
    "list_items": _of_role("ListItem", "file", "seg_ord", "line", "text"),
    "table_cells": _of_role("TableRow", "file", "seg_ord", "line", "text"),
    "paragraph_fold": paragraph_fold,
    "paragraph_fold_lines": paragraph_fold_lines,
    "resolve_line": resolve_lines,
    "code_spans": code_spans,
    "sentence_split": sentence_split,
    "parenthetical_sentences": parenthetical_sentences,
    "word_count": word_count,
    "rule_word_limit": rule_word_limit,
    "rule_semicolon": _placed("semicolon"),
    "rule_contraction": rule_contraction,
    "rule_passive": _quoted("passive_voice"),
    "rule_complex_verb": _quoted("complex_verb"),
    "rule_ing_form": _placed("ing_form"),
    "rule_paragraph_length": rule_paragraph_length,
    "dict_merge": dict_merge,
    "dict_match": dict_match,
    "dict_match_large": dict_match_large,
    "dict_file_allow": dict_file_allow,
    "dict_phrase_allow": dict_phrase_allow,
    "pos_guess": pos_guess,
    "sense_select": sense_select,
    "dict_message": dict_message,
    "profile_mode": profile_mode,
    "profile_rules": profile_rules,
    "profile_terms": profile_terms,
    "profile_phrases": profile_phrases,
    "summary_counts": summary_counts,
    "summary_by_file": summary_by_file,
    "gate_exit": gate_exit,
    "report_text": report_text,
    "report_json": report_json,
    "finding_order": finding_order,
    "dict_lookup": dict_lookup,
    "label_summary": label_summary,
    "full_lint": full_lint,
}

__all__ = ["ORACLES", "QUERIES"]
