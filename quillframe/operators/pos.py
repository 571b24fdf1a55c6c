"""A guess at a word's part of speech from its neighbours, as column expressions.

Signals for a verb and signals for a noun are gathered; where only one kind is
found the guess is that, else it is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import let, tokens

# Word lists of the signals. Fixed values.
MODALS = ("can", "could", "must", "will", "would", "should", "shall", "may", "might")
BE = ("is", "are", "was", "were", "be", "been", "being")
ARTICLES = ("a", "an", "the")
POSSESSIVES = ("my", "your", "his", "her", "its", "our", "their")
QUANTIFIERS = ("this", "these", "that", "those", "each", "every", "some", "any", "all", "no", "both")
PREPOSITIONS = ("of", "in", "on", "for", "with", "by", "from", "about", "at", "into", "onto", "through", "during")
FINITE = ("moves", "has", "does", "goes", "runs", "opens", "closes", "starts", "stops", "operates", "requires", "indicates", "shows", "displays", "connects", "controls")
CLAUSE_BREAKS = ("and", "or", "but", "so", "because", "if", "when", "while", "that", "which", "who", "than", "as")
ADJECTIVES = ("custom", "manual", "automatic", "primary", "secondary", "standard", "digital", "analog", "external", "internal", "optional", "additional", "main", "backup")
NO_COMPOUND = ("not", "never", "also", "already", "still", "just", "often")
#: How many words a determiner may stand before, and the code points looked at first for them.
REACH, WINDOW = 3, 160

_DETERMINERS = ARTICLES + POSSESSIVES + QUANTIFIERS + PREPOSITIONS
_FINITE = MODALS + BE + FINITE


def normal(token: Column) -> Column:
    """Lower case, without punctuation before; nor after, unless it ends in 's."""
    head = F.regexp_replace(token, f"^[^{P.WORD}]+", "")
    return F.lower(F.when(F.lower(token).endswith("'s"), head).otherwise(F.regexp_replace(head, f"[^{P.WORD}]+\\z", "")))


def _ends(word: Column, *tails: str) -> Column:
    found = word.endswith(tails[0])
    for t in tails[1:]:
        found = found | word.endswith(t)
    return found


def _modifier(raw: Column, word: Column) -> Column:
    stops = (word == "") | word.isin(*CLAUSE_BREAKS, *MODALS, *BE, "to")
    return ~stops & (_ends(word, "ing", "ed") | word.isin(*ADJECTIVES) | raw.rlike(r"^\p{Lu}"))


def governing(before: Column) -> Column:
    """The determiner that governs what follows the tokens ``before``: the nearest one, with modifiers only between; else null."""
    last = F.slice(F.reverse(before), 1, REACH)
    seen = F.transform(last, lambda raw: let(normal(raw), lambda w: F.struct(w.alias("w"), (w.isin(*_DETERMINERS) | w.endswith("'s")).alias("d"), _modifier(raw, w).alias("m"))))
    start = F.struct(F.lit(False).alias("over"), F.lit(None).cast("string").alias("word"))
    step = lambda a, x: F.struct((a["over"] | x["d"] | ~x["m"]).alias("over"), F.when(~a["over"] & x["d"], x["w"]).otherwise(a["word"]).alias("word"))
    return F.aggregate(seen, start, step, lambda a: a["word"])


def has_finite(text: Column) -> Column:
    """Whether a segment has a finite verb anywhere."""
    around = f"[^{P.WORD}{P.SPACE}]*+"
    return text.rlike(f"(?iu)(?<![^{P.SPACE}]){around}(?:{'|'.join(_FINITE)}){around}(?![^{P.SPACE}])")


def _before(text: Column, start: Column) -> Column:
    """The last ``REACH`` tokens or more before an offset, cut from a window where that has enough of them."""
    window = text.substr(F.greatest(start - WINDOW + 1, F.lit(1)), F.least(start, F.lit(WINDOW)))

    def cut(t: Column) -> Column:
        near = F.slice(t, F.lit(2), F.size(t))  # the first may be torn
        return F.when((start > WINDOW) & (F.size(t) > REACH), near).otherwise(tokens(text.substr(F.lit(1), start)))

    return F.when(start <= WINDOW, tokens(window)).otherwise(let(tokens(window), cut))


def _after(text: Column, end: Column) -> Column:
    """The tokens after an offset, from a window where that has more than one."""
    near = tokens(text.substr(end + 1, F.lit(WINDOW)))
    return let(near, lambda t: F.when(F.size(t) > 1, t).otherwise(tokens(text.substr(end + 1, F.length(text)))))


def _opens(text: Column, start: Column) -> Column:
    """Whether a sentence begins at an offset."""
    ends = lambda x: x.rlike(f"[.!?:]{P.S}+\\z")
    window = text.substr(F.greatest(start - WINDOW + 1, F.lit(1)), F.least(start, F.lit(WINDOW)))
    return (start == 0) | F.when(window.rlike(f"[^{P.SPACE}]"), ends(window)).otherwise(ends(text.substr(F.lit(1), start)))


def guess(text: Column, start: Column, end: Column, mode: Column, finite: Column | None = None) -> Column:
    """noun, verb or null for the words of ``text`` from ``start`` to ``end``; ``finite`` is ``has_finite`` of the text, if known."""
    context = F.struct(_before(text, start).alias("before"), F.try_element_at(_after(text, end), F.lit(1)).alias("next"), text.substr(start + 1, end - start).alias("match"))

    def decide(c: Column) -> Column:
        prev, following = normal(F.try_element_at(c["before"], F.lit(-1))), normal(c["next"])
        imperative = (mode == "procedure") & _opens(text, start)
        near = F.struct(prev.alias("prev"), following.alias("next"), governing(c["before"]).alias("gov"))
        return let(near, lambda n: _verdict(c["match"], n, imperative, has_finite(text) if finite is None else finite))

    return let(context, decide)


def _verdict(match: Column, n: Column, imperative: Column, finite: Column) -> Column:
    sure = lambda x: F.coalesce(x, F.lit(False))
    low = F.lower(match)
    number = F.regexp_replace(n["next"], "^[+-]+|[+-]+\\z", "").rlike(r"^[\p{Nd}.]+\z")
    verb = sure(n["prev"] == "to") | sure(n["prev"].isin(*MODALS)) | sure(n["prev"].isin(*BE) & low.endswith("ing")) | _ends(low, "ed", "ing") | sure(n["next"].isin(*ARTICLES)) | sure(number)
    compound = (
        n["next"].rlike(r"^\p{L}+\z")
        & ~n["next"].isin(*_DETERMINERS, *CLAUSE_BREAKS, *_FINITE, *NO_COMPOUND)
        & ~_ends(n["next"], "ing", "ed", "ly", "s")
    )
    determined = sure(n["prev"].isin(*_DETERMINERS)) | sure(n["prev"].endswith("'s")) | sure(n["gov"].isin(*_DETERMINERS))
    plural = match.endswith("s") & ~match.endswith("ss")

    def weigh(v: Column) -> Column:
        noun = determined | plural | sure(n["next"] == "of") | sure(n["next"].isin(*_FINITE)) | (sure(compound) & ~v["verb"]) | (~v["verb"] & ~finite)
        any_verb = v["imperative"] | v["verb"]
        return let(noun, lambda is_noun: F.when(any_verb & ~is_noun, "verb").when(is_noun & ~any_verb, "noun"))

    return let(F.struct(verb.alias("verb"), sure(imperative).alias("imperative")), weigh)
