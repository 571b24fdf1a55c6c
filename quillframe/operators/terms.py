"""Dictionary terms in text: matching, allowances, senses and messages.

Terms made of words are found by an equi-join: tokens of a segment that open some
term are kept (a set test inside the row), joined to the broadcast dictionary by
that first word, and the words that follow are compared. This costs a look-up a
token, where a pattern a term would read the text once a term. Terms with
other characters, or that can overlap themselves, are found by a pattern each.
Dictionaries too large for that are joined by ``joined_terms``, with equal results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..functions import patterns as P
from ..functions.text import SIGN, cut_at, let, located, places, resolve_line, running_sum, table_of, trimmed_left
from . import joined_terms
from .joined_terms import JoinedIndex
from .lexicon import described
from .pos import guess, has_finite
from .rules import DICTIONARY, FINDING, NONE

_PLAIN = rf"^{P.TERM_TOKEN}( {P.TERM_TOKEN})*\z"
#: A token of plain words, a narrower form of ``P.TERM_TOKEN`` that Python knows too; phrases of other letters take the way of odd ones.
_PY_TOKEN = "[A-Za-z0-9_-]+"
_SYMBOL = rf"[^{P.WORD}{P.SPACE}-]"
#: Entries up to which the dictionary is broadcast and its first words are a set in the plan.
BROADCAST_TERMS = 20_000
#: Entries up to which the dictionary is a constant table in the plan, so that findings are made inside a segment's row.
TABLE_TERMS = 1_000


_OPENING = "struct<first:string,start:int,value:string,words:array<string>,near:array<boolean>,ends:array<int>>"
_ODD_HIT = "struct<k:int,start:int,end:int>"
OPENING, ODD_HIT = f"array<{_OPENING}>", f"array<{_ODD_HIT}>"


def _by_pattern(term: Column, words: Column) -> Column:
    """Whether a term needs a pattern of its own: odd characters, or it could begin again within itself."""
    return ~term.rlike(_PLAIN) | term.contains("\u0130") | F.array_contains(F.slice(words, F.lit(2), F.size(words)), words[0])


def _folded(text: Column) -> Column:
    """One form of all texts that match one another in either case."""
    return F.lower(F.upper(F.lower(F.translate(text, "\u0130", "i"))))


def _anchor(term: Column) -> Column:
    """What any text with the term has: its longest token, else its first symbol, else nothing."""
    tokens = F.transform(F.regexp_extract_all(term, F.lit(f"({P.TERM_TOKEN})"), F.lit(1)), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))
    return _folded(F.coalesce(F.array_max(tokens)["t"], F.regexp_substr(term, F.lit(_SYMBOL)), F.lit("")))


@dataclass
class Index:
    """A dictionary made ready: plain terms by first word, odd ones by number."""

    plain: DataFrame
    odd: DataFrame | None
    odd_terms: list[str]
    words: list[list[str]]
    entries: list[dict] | None
    odd_entries: list[dict]
    schema: str


def index(dictionary: DataFrame, most: int | None = None) -> Index | JoinedIndex:
    """A dictionary of up to ``most`` entries (``BROADCAST_TERMS``) is broadcast, a larger one joined."""
    most = BROADCAST_TERMS if most is None else most
    spark = dictionary.sparkSession
    entries = described(dictionary.where("term is not null and term <> ''"))
    is_odd = _by_pattern(F.col("term"), F.col("words"))
    few = entries.withColumn("_odd", is_odd).limit(most + 1).collect()
    if len(few) > most:
        return joined_terms.index(entries, is_odd, _anchor, _SYMBOL)
    kinds = StructType([*entries.schema, StructField("_odd", BooleanType())])
    odd = [r for r in few if r["_odd"]]
    own = [r for r in few if not r["_odd"]]
    plain = spark.createDataFrame(own, kinds).drop("_odd").withColumn("_first", F.col("words")[0])
    numbered = spark.createDataFrame([(*r, k) for k, r in enumerate(odd)], StructType([*kinds, StructField("_k", IntegerType())])).drop("_odd") if odd else None
    return Index(F.broadcast(plain), F.broadcast(numbered) if odd else None, [r["term"] for r in odd], [list(r["words"]) for r in own], *_constants(own, odd, entries.schema))


def _constants(own: list[Row], odd: list[Row], kinds: StructType) -> tuple[list[dict] | None, list[dict], str]:
    """Entries by first word and odd ones for a constant table, unless they are too many, and the table's schema."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType([StructField("first", StringType()), *kinds]))
    if len(own) + len(odd) > TABLE_TERMS:
        return None, [], schema
    told = lambda r: {c: v for c, v in r.asDict(recursive=True).items() if c != "_odd"}
    return [{"first": r["words"][0]} | told(r) for r in own], [{"first": ""} | told(r) for r in odd], schema


def _opens(terms: list[list[str]]) -> str:
    """A pattern of tokens that open some term of these words. Its group is what may follow: the white space and tokens after, for tokens that open a term of several words.

    A token that opens only such terms must have some second word of theirs after it; those with letters beyond ASCII are not asked for.
    """
    before, after = P.NOT_IN_TERM
    alone = {t[0] for t in terms if len(t) == 1}
    longer: dict[str, set[str]] = {}
    for t in terms:
        if len(t) > 1:
            longer.setdefault(t[0], set()).add(t[1])
    asked = {w for w, seconds in longer.items() if w not in alone and all(map(str.isascii, seconds))}
    token = lambda words: f"{P.any_of(sorted(words), in_either_case=True)}{after}"
    tail = f"(?=((?:{P.S}++{P.TERM_TOKEN}+){{0,{max(map(len, terms)) - 1}}}))"
    free = set(longer) - asked
    going_on = [token(free)] if free else []
    if asked:
        going_on.append(f"{token(asked)}(?={P.S}++{token({x for w in asked for x in longer[w]})})")
    parts = [token(alone - set(longer))] if alone - set(longer) else []
    if going_on:
        parts.append(f"(?:{'|'.join(going_on)}){tail}")
    return f"{P.opens_any([t[0] for t in terms])}{before}(?:{'|'.join(parts)})"


def openings(terms: list[list[str]]) -> Column:
    """Tokens of text that open one of the ``terms`` (the words of each), by one pattern of all, each with the words that a term may go on with, as long as white space alone is between."""
    if not terms:
        return F.expr(f"cast(array() as {OPENING})")
    opens, longest = _opens(terms), max(map(len, terms))
    text, first = F.col("text"), lambda x: F.lower(x["value"])

    def alone(x: Column) -> Column:
        return F.struct(first(x).alias("first"), x["start"].alias("start"), x["value"].alias("value"), F.array(first(x)).alias("words"), F.array(F.lit(True)).alias("near"), F.array(x["end"]).alias("ends"))

    def followed(x: Column, parts: Column) -> Column:
        words = F.transform(parts, lambda p: F.lower(trimmed_left(p)))
        ends = F.transform(running_sum(F.transform(parts, F.length)), lambda n: n + x["end"])
        near = F.transform(parts, lambda p: F.lit(True))
        return F.struct(first(x).alias("first"), x["start"].alias("start"), x["value"].alias("value"), F.concat(F.array(first(x)), words).alias("words"), F.concat(F.array(F.lit(True)), near).alias("near"), F.concat(F.array(x["end"]), ends).alias("ends"))

    if longest == 1:
        return F.transform(located(text, opens), alone).cast(OPENING)
    cut = lambda tail: F.split(tail, f"(?<={P.TERM_TOKEN[:-1]})(?={P.S})", -1)
    opening = lambda x, tail: F.when(tail == "", alone(x)).otherwise(let(cut(tail), lambda parts: followed(x, parts)))
    match = lambda value, end: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))
    each = lambda x: F.transform(places(x, 2), lambda e, i: let(match(F.get(x, 3 * i + 1), e), lambda m: opening(m, F.get(x, 3 * i + 2))))
    none = F.expr(f"cast(array() as {OPENING})")
    once = let(cut_at(text, opens, ("$0", "$1")), lambda x: F.when(F.size(x) > 1, each(x).cast(OPENING)).otherwise(none))
    apart = F.zip_with(located(text, opens), F.regexp_extract_all(text, F.lit(opens), F.lit(1)), opening).cast(OPENING)
    return F.when(text.contains(SIGN), apart).otherwise(once)


def odd_hits(found: Index) -> Column:
    """Matches of the odd terms: number, start, end."""
    numbered = lambda k: lambda m: F.struct(F.lit(k).alias("k"), m["start"].alias("start"), m["end"].alias("end"))
    return F.concat(*(F.transform(located(F.col("text"), P.whole_term(t)), numbered(k)) for k, t in enumerate(found.odd_terms))).cast(ODD_HIT)


def marked(segments: DataFrame) -> DataFrame:
    """Adds what is asked of a segment once: its code spans and whether it has a finite verb."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return segments.withColumns({"_code": F.when(F.col("text").contains("`"), located(F.col("text"), P.CODE)).otherwise(none), "finite": has_finite(F.col("text"))})


def goes_on(opening: Column, words: Column) -> Column:
    """Whether a term that begins with an opening's word goes on as the text does, with white space alone between the words."""
    n = F.size(words)
    return (n == 1) | (F.slice(opening["words"], F.lit(1), n) == words) & F.forall(F.slice(opening["near"], F.lit(2), n - 1), lambda g: g)


def outside(start: Column, end: Column) -> Column:
    return ~F.exists("_code", lambda c: (start >= c["start"]) & (end <= c["end"]))


def matches(segments: DataFrame, dictionary: DataFrame, most: int | None = None) -> DataFrame:
    """A row for every place where a term stands as a whole outside code: the segment's columns, the entry's, start, end, match.

    Terms are matched in either case and across any white space, each on its own: overlapping terms all count.
    """
    return found_in(segments, index(dictionary, most))


def found_in(segments: DataFrame, found: Index | JoinedIndex) -> DataFrame:
    segments = marked(segments)
    if isinstance(found, JoinedIndex):
        hit = joined_terms.matches(segments, found, _folded, _SYMBOL)
    else:
        hit = segments.withColumn("_o", F.explode(openings(found.words))).join(found.plain, F.col("_o.first") == F.col("_first"))
        hit = hit.where(goes_on(F.col("_o"), F.col("words"))).withColumns({"start": F.col("_o.start"), "end": F.get("_o.ends", F.size("words") - 1)}).drop("_o", "_first")
        if found.odd is not None:
            more = segments.select("*", F.explode(odd_hits(found)).alias("_m")).join(found.odd, F.col("_m.k") == F.col("_k")).drop("_k")
            hit = hit.unionByName(more.withColumns({"start": F.col("_m.start"), "end": F.col("_m.end")}).drop("_m"))
    hit = hit.where(outside(F.col("start"), F.col("end"))).drop("_code")
    return hit.withColumn("match", F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")))


def allowed(term: Column, start: Column, end: Column) -> Column:
    """Whether a match is let through: its term is allowed for the file (column allowed, lower case), or it lies in an allowed phrase (phrase_spans)."""
    return F.array_contains("allowed", F.lower(term)) | F.exists("phrase_spans", lambda p: (start >= p["start"]) & (end <= p["end"]))


def unless_allowed(hits: DataFrame) -> DataFrame:
    return hits.where(~allowed(F.col("term"), F.col("start"), F.col("end")))


_PHRASE = "first string, phrase string, words array<string>"
_SPANS = "array<struct<start:int,end:int>>"


def phrase_spans(phrases: list[str]) -> Column:
    """Where those of the phrases that are allowed for the file (column phrases) stand in text.

    Places are found like those of terms: one pattern of all first words, and a look-up of the phrases that begin with each.
    Phrases of odd characters, or that could begin again within themselves, have a pattern each.
    """
    is_odd = lambda p: not re.match(rf"^{_PY_TOKEN}( {_PY_TOKEN})*\Z", p) or "\u0130" in p or p.split(" ")[0] in p.split(" ")[1:]
    odd = [p for p in phrases if is_odd(p)]
    plain = [{"first": p.split(" ")[0], "phrase": p, "words": p.split(" ")} for p in phrases if not is_odd(p)]
    if not phrases:
        return F.expr(f"cast(array() as {_SPANS})")
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    parts = [F.when(F.array_contains("phrases", p), F.transform(located(F.col("text"), P.whole_term(p)), lambda m: span(m["start"], m["end"]))).otherwise(F.expr(f"cast(array() as {_SPANS})")) for p in odd]
    if plain:
        known = table_of(plain, "first", _PHRASE)
        here = lambda o: F.filter(known(o["first"]), lambda p: F.array_contains("phrases", p["phrase"]) & goes_on(o, p["words"]))
        opened = openings([p["words"] for p in plain])
        parts.append(F.flatten(F.transform(opened, lambda o: F.transform(here(o), lambda p: span(o["start"], F.get(o["ends"], F.size(p["words"]) - 1))))))
    return F.when(F.size("phrases") > 0, F.concat(*parts)).otherwise(F.expr(f"cast(array() as {_SPANS})")).cast(_SPANS)


def candidates(senses: Column, pos: Column) -> Column:
    """The senses that a guess leaves: all, or those of that part of speech or any."""
    return F.when(pos.isNull(), senses).otherwise(F.filter(senses, lambda s: (s["pos"] == pos) | (s["pos"] == "any")))


def reported(pos: Column, left: Column, hit: Callable[[str], Column] = F.col) -> Column:
    """Whether a match is a finding: some sense is left, and acting on it could help."""
    single = pos.isNull() & (F.size(hit("senses")) == 1) & hit("self_ref")
    return ~(pos.isNotNull() & (F.size(left) == 0)) & ~hit("unactionable") & ~single


def part_label(pos: Column) -> Column:
    return F.when(pos == "any", "general").otherwise(pos)


def joined(alternatives: Column) -> Column:
    """'a'; 'a' or 'b'; 'a', 'b', or 'c'."""
    told = F.transform(alternatives, lambda a: F.concat(F.lit("'"), a, F.lit("'")))
    n = F.size(told)
    return F.when(n <= 2, F.array_join(told, " or ")).otherwise(F.concat(F.array_join(F.slice(told, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", or "), F.try_element_at(told, F.lit(-1))))


def message(match: Column, senses: Column, left: Column) -> Column:
    """struct(message, suggestion) of a finding; with other than one sense left it is ambiguous."""
    one = left[0]
    label = F.when(F.size(senses) > 1, F.concat(F.lit(" (used as a "), part_label(one["pos"]), F.lit(")"))).otherwise("")
    told = F.when(F.size(one["alternatives"]) > 0, F.concat(F.lit("use "), joined(one["alternatives"]), F.lit(" instead"))).otherwise("it is not an approved ASD-STE100-style term")
    confident = F.struct(
        F.concat(F.lit("Avoid '"), match, F.lit("'; "), told, label, F.lit(".")).alias("message"),
        F.when(F.size(one["alternatives"]) > 0, F.array_join(one["alternatives"], ", ")).alias("suggestion"),
    )
    each = F.transform(left, lambda s: F.concat(F.lit("as a "), part_label(s["pos"]), F.when(F.size(s["alternatives"]) > 0, F.concat(F.lit(", use "), joined(s["alternatives"]))).otherwise("")))
    hints = F.array_join(F.transform(left, lambda s: F.concat(F.array_join(s["alternatives"], ", "), F.lit(" ("), part_label(s["pos"]), F.lit(")"))), "; ")
    ambiguous = F.struct(
        F.concat(F.lit("Ambiguous part of speech for '"), match, F.lit("' — possible corrections: "), F.array_join(each, "; "), F.lit(".")).alias("message"),
        F.when(hints != "", hints).alias("suggestion"),
    )
    return F.when(F.size(left) == 1, confident).otherwise(ambiguous)


def judged(hits: DataFrame) -> DataFrame:
    """Adds pos, the guess, and left, the senses it leaves."""
    pos = guess(F.col("text"), F.col("start"), F.col("end"), F.col("mode"), F.col("finite"))
    return hits.withColumn("pos", pos).withColumn("left", candidates(F.col("senses"), F.col("pos")))


def own_findings(hit: Callable[[str], Column] = F.col) -> Column:
    """The finding of a match (start, end, match and its entry's columns, by default those of the row) as an array, empty where there is none.

    All is worked out in one expression: a filter on a guess would be pushed below it and guess again.
    """

    def told(pos: Column) -> Column:
        return let(candidates(hit("senses"), pos), lambda left: F.when(reported(pos, left, hit), let(hit("match"), lambda match: F.array(found(match, left)))).otherwise(F.expr(NONE)))

    def found(match: Column, left: Column) -> Column:
        text = message(match, hit("senses"), left)
        line = resolve_line(F.col("line_offsets"), hit("start"))
        return let(text, lambda m: F.struct(line.alias("line"), F.lit(DICTIONARY).alias("rule_code"), F.lit("error").alias("severity"), m["message"].alias("message"), m["suggestion"].alias("suggestion"), (-hit("term_length")).alias("rank"), hit("start").alias("offset")).cast(FINDING))

    pos = guess(F.col("text"), hit("start"), hit("end"), F.col("mode"), F.col("finite"))
    return let(F.when(hit("guessed"), pos), told)


def findings(hits: DataFrame) -> DataFrame:
    """Findings from allowed-for matches, in the columns of the structural ones; longer terms rank first."""
    rows = hits.select("file", F.lit(2).alias("pass"), "seg_ord", F.explode(own_findings()).alias("f"))
    return rows.select("file", "pass", "seg_ord", "f.rank", "f.offset", "f.line", "f.rule_code", "f.severity", "f.message", "f.suggestion")


def _in_row(found: Index) -> Column:
    """The dictionary findings of a segment as an array, from a constant table of the entries."""
    kind = f"array<struct<start:int,end:int,value:string,e:struct<{found.schema}>>>"
    hit = lambda start, end, value, e: F.struct(start.alias("start"), end.alias("end"), value.alias("value"), e.alias("e"))
    known = table_of(found.entries, "first", found.schema)
    met = lambda o: F.filter(known(o["first"]), lambda e: goes_on(o, e["words"]))
    hits = F.flatten(F.transform(openings(found.words), lambda o: F.transform(met(o), lambda e: hit(o["start"], F.get(o["ends"], F.size(e["words"]) - 1), F.when(F.size(e["words"]) == 1, o["value"]), e))))
    if found.odd_entries:
        table = F.from_json(F.lit(json.dumps(found.odd_entries)), f"array<struct<{found.schema}>>")
        hits = F.concat(hits, F.transform(odd_hits(found), lambda m: hit(m["start"], m["end"], F.lit(None).cast("string"), F.get(table, m["k"]))).cast(kind))
    hits = F.filter(hits, lambda h: outside(h["start"], h["end"]) & ~allowed(h["e"]["term"], h["start"], h["end"]))

    def own(h: Column) -> Column:
        match = F.coalesce(h["value"], F.col("text").substr(h["start"] + 1, h["end"] - h["start"]))
        return own_findings(lambda c: match if c == "match" else h[c] if c in ("start", "end") else h["e"][c])

    return F.flatten(F.transform(hits, own))


def with_rules(segments: DataFrame, found: Index, rule_findings: Column) -> DataFrame:
    """Structural and dictionary findings in one pass over segments.

    Of a small dictionary both kinds are made in the row and exploded together. Otherwise findings are exploded with openings, and only these meet the dictionary.
    """
    if isinstance(found, JoinedIndex):
        own = segments.select("file", F.lit(1).alias("pass"), "seg_ord", F.explode(rule_findings).alias("f"))
        own = own.select("file", "pass", "seg_ord", "f.rank", "f.offset", "f.line", "f.rule_code", "f.severity", "f.message", "f.suggestion")
        return own.unionByName(findings(unless_allowed(found_in(segments, found))))
    if found.entries is not None:
        rows = marked(segments).select("file", "seg_ord", F.explode(F.concat(rule_findings, _in_row(found))).alias("f"))
        return rows.select("file", F.when(F.col("f.rule_code") == DICTIONARY, 2).otherwise(1).alias("pass"), "seg_ord", "f.rank", "f.offset", "f.line", "f.rule_code", "f.severity", "f.message", "f.suggestion")
    odd_kind = _ODD_HIT
    rule = f"array<struct<f:{FINDING},o:{_OPENING},m:{odd_kind}>>"
    null = lambda kind: F.lit(None).cast(kind)
    parts = [
        F.transform(rule_findings, lambda f: F.struct(f.alias("f"), null(_OPENING).alias("o"), null(odd_kind).alias("m"))).cast(rule),
        F.transform(openings(found.words), lambda o: F.struct(null(FINDING).alias("f"), o.alias("o"), null(odd_kind).alias("m"))).cast(rule),
    ]
    if found.odd is not None:
        parts.append(F.transform(odd_hits(found), lambda m: F.struct(null(FINDING).alias("f"), null(_OPENING).alias("o"), m.alias("m"))).cast(rule))
    rows = marked(segments).withColumn("_u", F.explode(F.concat(*parts))).join(found.plain, F.col("_u.o.first") == F.col("_first"), "left")
    entry = ("term", "senses", "unactionable", "self_ref", "guessed", "term_length")
    is_rule, here = F.col("_u.f").isNotNull(), F.col("_first").isNotNull() & goes_on(F.col("_u.o"), F.col("words"))
    start, end = F.col("_u.o.start"), F.get("_u.o.ends", F.size("words") - 1)
    if found.odd is not None:
        odd = found.odd.select(*(F.col(c).alias(f"_{c}") for c in entry), "_k")
        rows = rows.join(odd, F.col("_u.m.k") == F.col("_k"), "left").withColumns({c: F.coalesce(c, f"_{c}") for c in entry})
        m = F.col("_u.m")
        here, start, end = here | m["start"].isNotNull(), F.coalesce(start, m["start"]), F.coalesce(end, m["end"])
    rows = rows.where(is_rule | here).withColumns({"is_rule": is_rule, "start": start, "end": end})
    let_by = F.col("is_rule") | (outside(F.col("start"), F.col("end")) & ~allowed(F.col("term"), F.col("start"), F.col("end")))
    rows = rows.where(let_by).withColumn("match", F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")))
    found = F.when(F.col("is_rule"), F.array("_u.f")).otherwise(own_findings())
    rows = rows.select("file", F.when(F.col("is_rule"), 1).otherwise(2).alias("pass"), "seg_ord", F.explode(found).alias("f"))
    return rows.select("file", "pass", "seg_ord", "f.rank", "f.offset", "f.line", "f.rule_code", "f.severity", "f.message", "f.suggestion")
