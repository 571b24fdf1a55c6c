"""Terms of dictionaries that are too large to broadcast.

Places, not texts, meet the dictionary: of each segment (its two hashes, its
places, a key) rows are shuffled, a Bloom filter of the dictionary's keys having
thrown out nearly all others. A key is a word, two words in a row for longer terms, or the
anchor of a term of odd characters. What matches goes back to its segment by
the hashes, once a segment, and only there longer and odd terms are compared with
the text. So what is shuffled grows with the text, not with its square, and a row
that matches nothing is not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import let, located, trimmed_left

#: Bits of a Bloom filter for a key, and at most: a megabyte in the plan. With more keys it lets more rows through, and loses none.
BITS_EACH, MOST_BITS = 16, 1 << 23
HASHES = 3

_KEY = "struct<key:string,start:int,end:int>"


def sieve(keys: DataFrame) -> Callable[[Column], Column]:
    """A test that is true of every text in the first column of ``keys``, and of few others."""
    size = min(MOST_BITS, 64 << (keys.count() * BITS_EACH // 64).bit_length())
    places = _places(F.col(keys.columns[0]), size)
    bits = keys.select(F.explode(places).alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word"))
    words = {r["word"]: r["bits"] for r in bits.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits")).collect()}
    if not words:
        return lambda value: F.lit(False)
    table = F.split(F.lit(",".join(str(words.get(k, 0)) for k in range(size // 64))), ",", -1).cast("array<bigint>")
    hit = lambda at: F.getbit(F.get(table, (at / 64).cast("int")), (at % 64).cast("int")) == 1
    return lambda value: F.forall(_places(value, size), hit)


def _places(value: Column, size: int) -> Column:
    one, two = F.xxhash64(value), F.hash(value).cast("long")
    return F.array(*(F.pmod(one.bitwiseXOR(F.shiftright(one, 29)) % size + two * k, F.lit(size)).cast("long") for k in range(HASHES)))


@dataclass
class JoinedIndex:
    """A dictionary made ready: entries by key, what may be one, and whether odd terms have symbols as anchors."""

    entries: DataFrame
    may_hold: Callable[[Column], Column]
    odd: bool
    symbols: bool
    blank_terms: list


def index(entries: DataFrame, odd: Column, anchor: Callable[[Column], Column], symbol: str) -> JoinedIndex:
    """``entries`` with their words; ``odd`` says which are matched by their own pattern. Blank ones, without an anchor, are told apart: they are runs of white space, and stay with the driver."""
    words, term = F.col("words"), F.col("term")
    entry = F.struct(*entries.columns)
    first = F.concat(F.lit("w"), F.array_join(F.slice(words, F.lit(1), F.least(F.size(words), F.lit(2))), " "))
    plain = entries.where(~odd).select(first.alias("key"), F.lit(None).cast("string").alias("pattern"), entry.alias("entry"))
    own = entries.where(odd).withColumn("_anchor", anchor(term))
    by_anchor = own.where("_anchor <> ''").select(F.concat(F.lit("a"), F.col("_anchor")).alias("key"), P.whole_term_column(term).alias("pattern"), entry.alias("entry"))
    keyed = plain.unionByName(by_anchor)
    kinds = by_anchor.agg(F.count("*").alias("n"), F.bool_or(F.col("key").substr(F.lit(2), F.length("key")).rlike(symbol)).alias("symbols")).first()
    blank = [r["entry"] for r in own.where("_anchor = ''").select(entry.alias("entry")).collect()]
    return JoinedIndex(keyed, sieve(keyed.select("key")), bool(kinds["n"]), bool(kinds["symbols"]), blank)


def keys_of(text: Column, folded: Callable[[Column], Column], symbol: str, found: JoinedIndex) -> Column:
    """What a segment may be joined by: each word and each two words in a row with their places, and the anchors that odd terms ask for, without."""
    key = lambda kind, value, start=None, end=None: F.struct(F.concat(F.lit(kind), value).alias("key"), *(F.lit(None).cast("int").alias(n) if x is None else x.alias(n) for n, x in (("start", start), ("end", end)))).cast(_KEY)

    def of(tokens: Column) -> Column:
        one = F.transform(tokens, lambda t: key("w", F.lower(t["value"]), t["start"], t["end"]))

        def pair(t: Column, i: Column) -> Column:
            after = F.get(tokens, i + 1)
            return F.when(trimmed_left(t["after"]) == "", key("w", F.concat(F.lower(t["value"]), F.lit(" "), F.lower(after["value"])), t["start"], after["end"]))

        parts = [one, F.filter(F.transform(tokens, pair), lambda x: x["key"].isNotNull())]
        if found.odd:
            parts.append(F.array_distinct(F.transform(tokens, lambda t: key("a", folded(t["value"])))))
        if found.symbols:
            parts.append(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({symbol})"), F.lit(1)), lambda s: key("a", folded(s)))))
        return F.concat(*parts)

    return let(located(text, P.TERM_TOKEN, gaps=True), of)


def _whole(text: Column, start: Column, words: Column) -> Column:
    """The text from ``start`` on that holds as many words as ``words``, if it holds those words."""
    pattern = F.concat(F.lit(f"^({P.TERM_TOKEN}+(?:{P.S}++{P.TERM_TOKEN}+){{"), (F.size(words) - 1).cast("string"), F.lit("})"))
    found = F.call_function("regexp_extract", text.substr(start + 1, F.length(text)), pattern, F.lit(1))
    return let(found, lambda m: F.when(F.split(F.lower(m), f"{P.S}+", -1) == words, m))


def matches(segments: DataFrame, found: JoinedIndex, folded: Callable[[Column], Column], symbol: str) -> DataFrame:
    """Every place of every term, code or not: the segment's columns, the entry's, start, end.

    Segments that are alike in file, place and text share their matches, and each gets all of them.
    """
    by = {"_a": F.xxhash64("file", "seg_ord", "text"), "_b": F.xxhash64("text", "seg_ord", "file")}
    span = "array<struct<start:int,end:int>>"
    spans = lambda pattern: F.transform(located(F.col("text"), pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).cast(span)
    rows = segments.select(*(c.alias(n) for n, c in by.items()), F.explode(keys_of(F.col("text"), folded, symbol, found)).alias("k")).select("_a", "_b", "k.*")
    met = rows.where(found.may_hold(F.col("key"))).join(found.entries, "key").drop("key")
    # shuffled by segment once, for taking repeats out and for the join back
    met = met.repartition("_a", "_b").dropDuplicates(["_a", "_b", "start", "entry"])
    back = segments.withColumns(by).join(met, ["_a", "_b"])
    here = F.array(F.struct(F.col("start"), F.col("end"))).cast(span)
    words, text = F.col("entry.words"), F.col("text")
    longer = let(_whole(text, F.col("start"), words), lambda m: F.when(m.isNotNull(), F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.length(m)).alias("end"))).cast(span)))
    placed = F.when(F.col("pattern").isNotNull(), spans(F.col("pattern"))).when(F.size(words) <= 2, here).otherwise(longer)
    out = back.withColumn("_m", F.explode(placed)).select(*segments.columns, "entry.*", "_m.start", "_m.end")
    for entry in found.blank_terms:
        columns = [F.lit(entry[c]).cast(t).alias(c) if not isinstance(entry[c], list) else F.from_json(F.lit(_json(entry[c])), t).alias(c) for c, t in found.entries.select("entry.*").dtypes]
        more = segments.select("*", *columns, F.explode(spans(P.whole_term(entry["term"]))).alias("_m"))
        out = out.unionByName(more.select(*out.columns[:-2], "_m.start", "_m.end"))
    return out


def _json(value) -> str:
    import json

    plain = lambda v: v.asDict(True) if hasattr(v, "asDict") else v
    return json.dumps([plain(v) for v in value])
