"""Sentences of a segment and their counts of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import leading_space, let, located, running_sum, tokens, trimmed, trimmed_left

#: What counts as one word, the letter that stands for it, and what a text with it has. The order is part of the rule.
ONE_WORD = ((P.CODE, "C", "`"), (P.QUOTED, "Q", '"'), (P.PARENTHESES, "P", "("), (P.NUMBER_UNIT, "N", None), (P.TITLE_RUN, "T", None))


def word_count(text: Column) -> Column:
    """Words of a sentence; code, quotations, parentheses, quantities and runs of capitalised words count once."""

    def counted(t: Column, rules: tuple) -> Column:
        if not rules:
            return F.size(tokens(t))
        (pattern, letter, sign), *rest = rules
        told = F.regexp_replace(t, pattern, letter)
        return let(F.when(t.contains(sign), told).otherwise(t), lambda x: counted(x, tuple(rest))) if sign else counted(told, tuple(rest))

    return counted(text, ONE_WORD)


def is_sentence(text: Column) -> Column:
    """Whether a text stands as a sentence: a capital first, a full stop, exclamation or question mark last."""
    return (F.length(text) >= 2) & text.rlike(r"^\p{Lu}") & text.rlike(r"[.!?]\z")


def counted_over(text: Column, most: Column) -> Column:
    """``word_count`` of a sentence with more than ``most`` words, else null.

    What counts as one word holds one token or more, so tokens are never fewer than words, and a text has a character between two of them.
    """
    n = lambda: let(word_count(text), lambda n: F.when(n > most, n))
    return F.when((F.length(text) > 2 * most.cast("long")) & (F.size(tokens(text)) > most), n())


def _sentence(text: Column, offset: Column, counted: bool) -> Column:
    return F.struct(text.alias("text"), *([word_count(text).alias("word_count")] if counted else []), offset.alias("start_offset"))


def _with_inner(text: Column, offset: Column, counted: bool) -> Column:
    """A sentence, then the sentences in its parentheses."""
    raw = lambda m: m["value"].substr(F.lit(2), F.length(m["value"]) - 2)
    inner = F.transform(located(text, P.PARENTHESES), lambda m: F.struct(trimmed(raw(m)).alias("t"), (offset + m["start"] + 1 + leading_space(raw(m))).alias("o")))
    inner = F.filter(inner, lambda x: is_sentence(x["t"]))
    own = F.array(_sentence(text, offset, counted))
    return F.when(text.contains("("), F.concat(own, F.transform(inner, lambda x: _sentence(x["t"], x["o"], counted)))).otherwise(own)


def sentences(text: Column, counted: bool = True) -> Column:
    """array<struct<text, word_count, start_offset>>; a sentence in parentheses follows the one that holds it. word_count is left out if not ``counted``."""

    def cut(x: Column) -> Column:
        # a part begins with the white space before its sentence
        ends = lambda parts: running_sum(F.transform(parts, F.length))
        placed = lambda parts: F.zip_with(parts, ends(parts), lambda p, e: F.struct(trimmed_left(p).alias("t"), e.alias("e")))
        own = let(F.split(x["t"], P.SENTENCE_END, -1), placed)
        return F.flatten(F.transform(F.filter(own, lambda p: p["t"] != ""), lambda p: _with_inner(p["t"], p["e"] - F.length(p["t"]) + x["lead"], counted)))

    return let(F.struct(trimmed(text).alias("t"), leading_space(text).alias("lead")), cut)
