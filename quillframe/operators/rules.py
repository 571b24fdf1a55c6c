"""Structural rules: each turns a segment into an array of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import let, located, masked_code, outside_code, resolve_line, truncated
from .sentences import counted_over, sentences

FINDING = "struct<line:int,rule_code:string,severity:string,message:string,suggestion:string,rank:int,offset:int>"
NONE = f"cast(array() as array<{FINDING}>)"

# Rule codes and texts of findings. Fixed values.
WORD_LIMIT, SEMICOLON, CONTRACTION, DICTIONARY = "STE100-4.1", "STE100-8.1", "STE100-4.2", "STE100-DICT"
PASSIVE, COMPLEX, ING, PARAGRAPH = "STE100-ADV-PASSIVE", "STE100-ADV-COMPLEXVERB", "STE100-ADV-INGFORM", "STE100-ADV-PARA"
TEXTS = {
    WORD_LIMIT: ('Sentence has %d words, exceeding the %d-word limit for %s mode: "%s"', "Split into shorter sentences."),
    SEMICOLON: ("Semicolons are not permitted in ASD-STE100 prose.", "Split into two separate sentences."),
    CONTRACTION: ("Contraction '%s' is not permitted in ASD-STE100 prose.", "Write the words in full."),
    PASSIVE: ('Possible passive voice (advisory heuristic, not an official STE100 rule): "%s"', "Consider rewriting in active voice."),
    COMPLEX: ('Possible complex verb construction (perfect/modal-perfect tense) — ASD-STE100 prefers simple present, past, or future tense verbs: "%s"', "Rewrite using a simple tense verb."),
    ING: (
        "The '-ing' form '%s' may need review — ASD-STE100 restricts '-ing' forms to technical nouns/adjectives, not verb forms.",
        "Confirm this is a technical noun or adjective, not a present-participle verb; otherwise rewrite using a simple tense verb.",
    ),
    PARAGRAPH: ("Paragraph has %d sentences, exceeding the advisory limit of %d (not an official STE100 rule).", "Split into shorter paragraphs."),
}


def finding(code: str, severity: Column, rank: int, line: Column, offset: Column, *args: Column) -> Column:
    message, suggestion = TEXTS[code]
    told = F.format_string(message, *args) if args else F.lit(message)
    return F.struct(line.alias("line"), F.lit(code).alias("rule_code"), severity.alias("severity"), told.alias("message"), F.lit(suggestion).alias("suggestion"), F.lit(rank).alias("rank"), offset.alias("offset")).cast(FINDING)


def _when(enabled: Column, found: Column) -> Column:
    return F.when(enabled, found).otherwise(F.expr(NONE))


def _at(offset: Column) -> Column:
    return resolve_line(F.col("line_offsets"), offset)


def _most_words() -> Column:
    return F.when(F.col("mode") == "procedure", F.col("rules.max_words_procedure")).otherwise(F.col("rules.max_words_descriptive"))


def word_limit() -> Column:
    most = _most_words()
    counted = F.transform("sentences", lambda s: F.struct(s["text"].alias("text"), s["start_offset"].alias("start_offset"), counted_over(s["text"], most).alias("word_count")))
    long = F.filter(counted, lambda s: s["word_count"].isNotNull())
    return F.transform(long, lambda s: finding(WORD_LIMIT, F.lit("error"), 1, _at(s["start_offset"]), s["start_offset"], s["word_count"], most, F.col("mode"), truncated(s["text"])))


def semicolon() -> Column:
    """The first one outside code; at most one a segment."""
    hits = F.slice(outside_code(F.col("text"), ";"), 1, 1)
    return _when(~F.col("rules.allow_semicolons") & F.col("text").contains(";"), F.transform(hits, lambda m: finding(SEMICOLON, F.lit("error"), 2, _at(m["start"]), m["start"])))


def contraction() -> Column:
    """All outside code but possessives: 's counts only after words for which it means is or has."""
    word = lambda m: F.lower(F.substring_index(m["value"], "'", 1))
    hits = F.filter(outside_code(F.col("text"), P.CONTRACTION), lambda m: ~F.lower(m["value"]).endswith("'s") | word(m).isin(*P.IS_WORDS))
    return _when(~F.col("rules.allow_contractions") & F.col("text").contains("'"), F.transform(hits, lambda m: finding(CONTRACTION, F.lit("error"), 3, _at(m["start"]), m["start"], m["value"])))


def _is_like(pattern: str):
    return lambda s: masked_code(s["text"]).rlike(pattern)


def _sentences_like(code: str, knob: str, pattern: str, rank: int) -> Column:
    hits = F.filter("sentences", _is_like(pattern))
    severity = F.col(f"rules.{knob}")
    return _when(severity != "off", F.transform(hits, lambda s: finding(code, severity, rank, _at(s["start_offset"]), s["start_offset"], truncated(s["text"]))))


def complex_verb() -> Column:
    return _sentences_like(COMPLEX, "complex_verb", P.COMPLEX_VERB, 4)


def passive_voice() -> Column:
    return _sentences_like(PASSIVE, "passive_voice", P.PASSIVE, 5)


def ing_form() -> Column:
    """Words in -ing outside code, unless a full stop touches them, as in names of files."""
    severity = F.col("rules.ing_form")
    touched = lambda m: m["gap"].endswith(".") | m["after"].startswith(".")
    hits = F.filter(outside_code(F.col("text"), P.ING_FORM, gaps=True), lambda m: ~touched(m))
    return _when((severity != "off") & F.lower("text").contains("ing"), F.transform(hits, lambda m: finding(ING, severity, 6, _at(m["start"]), m["start"], m["value"])))


def paragraph_length() -> Column:
    most, n = F.col("rules.max_sentences_paragraph"), F.size("sentences")
    return _when((F.col("role") == "Paragraph") & (most > 0) & (n > most), F.array(finding(PARAGRAPH, F.lit("warn"), 7, F.col("line"), F.lit(0), n, most)))


RULES = {"word_limit": word_limit, "semicolon": semicolon, "contraction": contraction, "complex_verb": complex_verb, "passive_voice": passive_voice, "ing_form": ing_form, "paragraph_length": paragraph_length}


def with_sentences(segments: DataFrame, counted: bool = True) -> DataFrame:
    """Adds sentences; the rules count the words themselves, of those that could be over a limit."""
    return segments.withColumn("sentences", sentences(F.col("text"), counted))


def every(*names: str) -> Column:
    """The findings of the named rules, all by default, as one array."""
    return F.concat(*(RULES[n]() for n in names or RULES))


def structural(segments: DataFrame, *names: str) -> DataFrame:
    """Findings of the named rules (all of them by default): (file, pass, seg_ord, rank, offset, line, rule_code, severity, message, suggestion).

    ``segments`` has mode and rules as well; each segment is read once for all rules. Nothing is shuffled.
    """
    rows = with_sentences(segments, counted=False).select("file", "seg_ord", F.explode(every(*names)).alias("f"))
    return rows.select("file", F.lit(1).alias("pass"), "seg_ord", "f.rank", "f.offset", "f.line", "f.rule_code", "f.severity", "f.message", "f.suggestion")


def worst() -> Column:
    """struct<error, some>: whether a segment has an error, and whether it has an error or a warning.

    A rule is asked only as long as the rules before it leave the answer open, and a sentence as long as those before it do.
    """
    some = lambda found: F.size(found) > 0
    error = some(semicolon()) | some(contraction()) | F.exists("sentences", lambda s: counted_over(s["text"], _most_words()).isNotNull())
    knobs = {"passive_voice": F.exists("sentences", _is_like(P.PASSIVE)), "complex_verb": F.exists("sentences", _is_like(P.COMPLEX_VERB)), "ing_form": some(ing_form())}
    warning = some(paragraph_length())
    for knob, hit in knobs.items():
        severity = F.col(f"rules.{knob}")
        error, warning = error | ((severity == "error") & hit), warning | ((severity == "warn") & hit)
    return let(error, lambda e: F.struct(e.alias("error"), (e | warning).alias("some")))


def code_spans(text: Column) -> Column:
    return F.transform(located(text, P.CODE), lambda m: F.struct(m["start"].alias("start"), (m["end"] - m["start"]).alias("len")))
