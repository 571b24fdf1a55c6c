"""Personal data by weak supervision, in DataFrame expressions alone.

Base spans are matches of strict patterns. Looser patterns propose further
candidates. Labelers vote on every candidate, base ones included: its form and
shape, a gazetteer of domains, networks, issuers and calling codes, words that
stand before it, what touches it, and the digits' own checks say yes, no or
nothing. Votes are counted by pattern and kind over the whole corpus, a table of
bounded size; there expectation-maximisation estimates for each kind how reliable
each labeler is, and so how likely each candidate is personal data. On these
estimates a logistic classifier for each kind is trained, whose inputs are
features of the span and of its context. Their patterns are counted over
the whole corpus too, so training is on a bounded table, and it decides, as a
column expression, which of the loose candidates become spans.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, running
from .common import keep

KINDS = ("email", "ip", "card", "phone")

# Base forms. Runs are possessive and start where a run or the last match ends, so that
# long texts take linear time; they find what the leftmost greedy forms find.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass before a pattern is tried.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}

# Loose forms: the same kinds written otherwise. A name in an address is a whole run; groups of digits have the sizes of their kind.
_AT, _DOT = r"\x20?[(\[{](?i:at)[)\]}]\x20?", r"(?:\x20?[(\[{](?i:dot)[)\]}]\x20?|\x20(?i:dot)\x20)"
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]*+(?:{_AT}[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++)++|\x20(?i:at)\x20[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])|(?<![0-9])[0-9]{1,3}(?:[(\[]\.[)\]][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9-])[0-9]{4}[. _/][0-9]{4}[. _/][0-9]{4}[. _/][0-9]{1,7}(?![0-9])|(?<![0-9.-])3[47][0-9]{2}[ .-]?[0-9]{6}[ .-]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])|(?<![0-9+.-])00[1-9](?:[ ().-]{0,2}[0-9]){7,13}(?![0-9])",
}

# Words that speak for a kind when they stand shortly before, and words that speak against all kinds.
CONTEXT = {
    "email": r"e-?mail|contact|write|mailto|reach|courriel|correo",
    "ip": r"\bip\b|ipv[46]|host|server|address|client|network|login",
    "card": r"card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel\b|call|mobile|fax|contact|whatsapp|telefon",
}
AGAINST = r"version|licen[cs]e|section|page|figure|isbn|release|build|chapter|serial|invoice|order|part\b|model"
#: Fixed values, the default gazetteer: last parts of domains, networks that are no one's, first digits of card issuers, and calling codes, with n before the first digit of areas of a plan without them.
GAZETTEER = {
    "email": "com org net edu gov mil int io co ai me tv app dev info biz mail name eu de fr es it nl be at ch pl pt se no dk fi ie uk us ca mx br ar cl au nz in jp cn kr ru tr gr cz hu ro za".split(),
    "ip": ["0", "10", "127", "192.168", "169.254", *(f"172.{k}" for k in range(16, 32))],
    "card": ["4", "34", "37", "36", "38", "51", "52", "53", "54", "55", "65", "6011", *map(str, range(22, 28))],
    "phone": "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98 212 213 234 254 351 352 353 358 380 420 421 971 972 974 n2 n3 n4 n5 n6 n7 n8 n9".split(),
}
LABELERS = ("form", "shape", "gazetteer", "context", "against", "touching", "check")
#: Inputs of the classifier: of the span and what stands around it.
FEATURES = ("bracketed", "spaced", "mixed", "long", "few_digits", "listed", "checked", "cued", "warned", "colon", "line_start", "glued", "closed")
AROUND = 40
ROUNDS = 200
#: Weight of what is taken for granted of a labeler, in candidates, and the shares of its yes and no votes among true and false ones.
TRUST, YES, NO = 10.0, (0.1, 0.5), (0.4, 0.05)

_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
_MARKED = "struct<kind:string,start:int,end:int,votes:int,bits:int>"


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places in code points, and up to ``AROUND`` characters before and after, as far as the next match."""

    def placed(x: Column) -> Column:
        ends = running(F.zip_with(x["m"], F.slice(x["g"], F.lit(1), F.size(x["m"])), lambda m, g: F.length(m) + F.length(g)), lambda a, b: a + b)
        near = F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["m"])), F.slice(x["g"], F.lit(2), F.size(x["m"])), lambda b, a: F.struct(F.substring(b, -AROUND, AROUND).alias("b"), F.substring(a, 1, AROUND).alias("a")))
        both = F.zip_with(x["m"], near, lambda m, n: F.struct(m.alias("m"), n["b"].alias("b"), n["a"].alias("a")))
        return F.zip_with(both, ends, lambda p, e: F.struct((e - F.length(p["m"])).alias("start"), e.alias("end"), p["m"].alias("value"), p["b"].alias("before"), p["a"].alias("after")))

    return let(F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("m"), F.split(text, pattern, -1).alias("g")), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass Luhn's check."""
    digits = F.split(F.reverse(_digits(value)), "")

    def part(d, i):
        twice = 2 * d.cast("int")
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    kept = F.filter(digits, lambda d: d != "")
    return F.when(F.length(_digits(value)) > 0, F.aggregate(F.transform(kept, part), F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    size = F.length(_digits(value))
    if kind == "card":
        return size.between(16, 19) & luhn(value)
    return size.between(8, 15)


def _checks(kind: str, value: Column, digits: Column) -> Column:
    """Whether a candidate could be what it looks like."""
    size = F.length(digits)
    if kind == "email":
        return value.rlike(r"[A-Za-z]{2}")
    if kind == "ip":
        plain = F.regexp_replace(value, r"[()\[\]]", "")
        groups, gap = F.size(F.split(value, ":", -1)), F.size(F.split(value, "::", -1))
        return valid("ip", plain) | (value.contains(":") & value.rlike("[A-Fa-f]") & (((groups == 8) & (gap == 1)) | ((groups < 9) & (gap == 2))))
    if kind == "card":
        return size.between(13, 19) & luhn(value)
    return size.between(8, 15)


def _listed(kind: str, value: Column, digits: Column, entries: Iterable[str]) -> Column:
    entries = list(entries)
    if kind == "email":
        return F.lower(F.regexp_extract(value, "[A-Za-z0-9-]+$", 0)).isin(*entries)
    if kind == "ip":
        parts = F.split(F.regexp_replace(value, r"[()\[\]]", ""), r"\.")
        return F.coalesce(parts[0].isin(*entries) | F.concat_ws(".", F.slice(parts, 1, 2)).isin(*entries), F.lit(False))
    start = F.when(value.startswith("00"), digits.substr(F.lit(3), F.lit(4))).otherwise(digits) if kind == "phone" else digits
    heads = lambda x: reduce(lambda a, n: a | F.substring(x, 1, n).isin(*entries), (2, 3, 4), F.substring(x, 1, 1).isin(*entries))
    if kind == "phone":
        return F.when(value.startswith("+") | value.startswith("00"), heads(start)).otherwise(F.concat(F.lit("n"), F.substring(digits, 1, 1)).isin(*entries))
    return heads(start)


def _shape(kind: str, value: Column) -> Column:
    """Whether the way of writing speaks for a kind, or separators that change in the middle against it."""
    if kind == "email":
        return F.when(value.rlike(r"[(\[{]"), 1).otherwise(0)
    if kind == "ip":
        return F.when(value.rlike(r"[(\[]"), 1).otherwise(0)
    one = value.rlike(r"^\(?[0-9]+\)?([. _/-])[0-9]+(?:\1[0-9]+)*$")
    several = value.rlike(r"[0-9][. _/-]+[0-9]+[. _/-]+[0-9]") & ~value.startswith("(") & ~value.startswith("+") & ~value.startswith("00")
    return F.when(one, 1).when(several, -1).otherwise(0)


def _marks(kind: str, x: Column, strict: bool, gazetteer: dict[str, Iterable[str]]) -> Column:
    """struct(kind, start, end, votes, bits) of a candidate: the labelers' votes as digits to base 3, and the features as bits."""

    def told(c: Column) -> Column:
        value, low = x["value"], c["low"]
        touching = x["before"].rlike(r"[A-Za-z0-9][./:_-]?$|[0-9][,.]$") | x["after"].rlike(r"^[./:_-]?[0-9A-Za-z]")
        cued, warned = low.rlike(CONTEXT[kind]), low.rlike(AGAINST)
        votes = {
            "form": F.lit(1 if strict else 0),
            "shape": _shape(kind, value),
            "gazetteer": F.when(c["listed"], -1).otherwise(0) if kind == "ip" else F.when(c["listed"], 1).otherwise(-1),
            "context": F.when(cued, 1).otherwise(0),
            "against": F.when(warned, -1).otherwise(0),
            "touching": F.when(touching, -1).otherwise(0),
            "check": F.when(c["checked"], 1).otherwise(-1),
        }
        features = {
            "bracketed": value.rlike(r"[(\[{]"),
            "spaced": value.contains(" "),
            "mixed": value.rlike("[0-9]") & value.rlike("[A-Za-z]"),
            "long": F.length(value) > 20,
            "few_digits": F.length(c["digits"]) < 10,
            "listed": c["listed"],
            "checked": c["checked"],
            "cued": cued,
            "warned": warned,
            "colon": low.rlike(r"[:=]\s*$"),
            "line_start": low.rlike(r"(?:^|\n)\s*$"),
            "glued": touching,
            "closed": x["after"].rlike(r"^\s*(?:$|[.,;)\n])"),
        }
        code = reduce(lambda a, k: a * 3 + votes[k] + 1, LABELERS, F.lit(0))
        bits = reduce(lambda a, kv: a + F.when(kv[1], 1 << kv[0]).otherwise(0), enumerate(features[f] for f in FEATURES), F.lit(0))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), code.cast("int").alias("votes"), bits.cast("int").alias("bits"))

    def with_checks(digits: Column) -> Column:
        known = F.struct(F.lower(x["before"]).alias("low"), digits.alias("digits"), _listed(kind, x["value"], digits, gazetteer[kind]).alias("listed"), _checks(kind, x["value"], digits).alias("checked"))
        return let(known, told)

    return let(_digits(x["value"]), with_checks)


def apart(loose: Column, base: Column) -> Column:
    """The spans of ``loose`` that overlap none of ``base``: one pass over both in order."""
    far = F.lit(-(1 << 30))

    def judged(every: Column) -> Column:
        upto = running(F.transform(every, lambda y: F.when(y["loose"], far).otherwise(y["x"]["end"])), F.greatest)
        after = F.reverse(running(F.reverse(F.transform(every, lambda y: F.when(y["loose"], far).otherwise(-y["x"]["start"]))), F.greatest))
        free = lambda y, z: F.when(y["loose"] & (z["upto"] <= y["x"]["start"]) & (-z["after"] >= y["x"]["end"]), y["x"])
        return F.filter(F.zip_with(every, F.zip_with(upto, after, lambda a, b: F.struct(a.alias("upto"), b.alias("after"))), free), lambda y: y.isNotNull())

    mark = lambda spans, flag: F.transform(spans, lambda x: F.struct(x["start"].alias("at"), F.lit(flag).alias("loose"), x.alias("x")))
    return F.when((F.size(loose) == 0) | (F.size(base) == 0), loose).otherwise(let(F.array_sort(F.concat(mark(base, False), mark(loose, True))), judged))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gazetteer: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """(doc_id, base, loose): arrays of struct(kind, start, end, votes, bits) for every row.

    base holds the valid strict matches by kind and start, leftmost and not overlapping by kind; matches that fail are
    dropped. loose holds the other candidates that touch no base span.
    """
    listed = {**GAZETTEER, **(gazetteer or {})}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none, text = F.expr(f"cast(array() as array<{_SPAN}>)"), F.col("text")
    found, passes = {}, lambda kind: lambda x: valid(kind, x["value"])
    for kind in KINDS:
        hits = F.filter(located(text, BASE[kind]), passes(kind))
        need = text.contains(_NEEDS[kind]) if kind in _NEEDS else F.lit(True)
        found[f"base_{kind}"] = F.when(need & text.rlike(BASE[kind]), hits).otherwise(none)
        found[f"loose_{kind}"] = F.when(text.rlike(LOOSE[kind]), located(text, LOOSE[kind])).otherwise(none)
    rows = rows.select("doc_id", *(v.alias(k) for k, v in found.items()))
    marks = lambda kind, strict: lambda x: _marks(kind, x, strict, listed)
    marked = lambda where, strict: F.concat(*(F.transform(f"{where}_{k}", marks(k, strict)) for k in KINDS)).cast(f"array<{_MARKED}>")
    rows = rows.select("doc_id", marked("base", True).alias("base"), marked("loose", False).alias("rest"))
    return rows.select("doc_id", "base", apart(F.col("rest"), F.col("base")).alias("loose"))


def votes_of(code: int) -> dict[str, int]:
    out = {}
    for k in reversed(LABELERS):
        code, vote = divmod(code, 3)
        out[k] = vote - 1
    return out


def vote_counts(found: DataFrame) -> dict[str, list[tuple[int, int]]]:
    """By kind, how often each pattern of votes occurs: at most 3 ** 7 of them, whatever the corpus."""
    each = found.select(F.explode(F.concat("base", "loose")).alias("x")).groupBy("x.kind", "x.votes").agg(F.count("*").alias("n"))
    out = defaultdict(list)
    for r in sorted(each.collect()):
        out[r["kind"]].append((r["votes"], r["n"]))
    return dict(out)


def reliabilities(table: list[tuple[int, int]], rounds: int = ROUNDS) -> tuple[dict[str, dict[int, tuple[float, float]]], list[float]]:
    """Expectation-maximisation over the vote patterns (code, count) of one kind.

    Returns P(vote | false, true) by labeler, and each pattern's probability of being personal data. A vote of none
    says nothing. Labelers start from, and are held to, ``TRUST`` candidates' worth of what they mean to say; the
    prior is that of candidates without the strict form, as those with it are not in question.
    """
    votes = [votes_of(code) for code, _ in table]
    count = [n for _, n in table]
    belief = [0.5 + 0.4 * max(-1.0, min(1.0, sum(v.values()) / 2)) for v in votes]
    rates: dict[str, dict[int, tuple[float, float]]] = {}
    for _ in range(rounds):
        total = [sum(n * (1 - b) for n, b in zip(count, belief)), sum(n * b for n, b in zip(count, belief))]
        loose = [(n, b) for n, b, v in zip(count, belief, votes) if v["form"] == 0]
        prior = (sum(n * b for n, b in loose) + 1) / (sum(n for n, _ in loose) + 2)
        for k in LABELERS:
            rates[k] = {}
            for vote, share in ((1, YES), (-1, NO)):
                hit = [sum(n * (1 - b) for n, b, v in zip(count, belief, votes) if v[k] == vote), sum(n * b for n, b, v in zip(count, belief, votes) if v[k] == vote)]
                rates[k][vote] = tuple((hit[c] + TRUST * share[c]) / (total[c] + TRUST) for c in (0, 1))
        odds = [math.log(prior / (1 - prior)) + sum(math.log(rates[k][v[k]][1] / rates[k][v[k]][0]) for k in LABELERS if v[k]) for v in votes]
        new = [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in odds]
        done = max(abs(a - b) for a, b in zip(new, belief)) < 1e-6
        belief = new
        if done:
            break
    return rates, belief


def classifier(table: list[tuple[int, float, float]], steps: int = 400, decay: float = 0.002) -> list[float]:
    """Logistic weights of the features, then the bias, fitted to (bits, count, sum of estimated probabilities) by Newton steps with a small ridge."""
    bits = np.array([b for b, _, _ in table])
    x = np.column_stack([(bits[:, None] >> np.arange(len(FEATURES))) & 1, np.ones(len(bits))]).astype(float)
    n, p = np.array([c for _, c, _ in table], float), np.array([s for _, _, s in table], float)
    w, ridge = np.zeros(x.shape[1]), decay * max(1.0, n.sum()) * np.eye(x.shape[1])
    ridge[-1, -1] *= 0.01
    for _ in range(steps):
        f = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * f - p) + ridge @ w
        move = np.linalg.solve(x.T @ ((n * f * (1 - f) + 1e-9)[:, None] * x) + ridge, slope)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w.tolist()


def trained(found: DataFrame) -> dict[str, list[float]]:
    """The classifier's weights by kind, from all candidates: at most 2 ** 13 patterns of features a kind meet here."""
    spark, counts = found.sparkSession, vote_counts(found)
    if not counts:
        return {}
    known = [{"kind": kind, "votes": code, "belief": b} for kind, table in counts.items() for (code, _), b in zip(table, reliabilities(table)[1])]
    rows = F.from_json(F.lit(json.dumps(known)), "array<struct<kind:string,votes:int,belief:double>>")
    beliefs = F.broadcast(spark.range(1).select(F.inline(rows)))
    each = found.select(F.explode(F.concat("base", "loose")).alias("x")).select("x.kind", "x.votes", "x.bits").groupBy("kind", "votes", "bits").agg(F.count("*").alias("n"))
    rows = each.join(beliefs, ["kind", "votes"]).groupBy("kind", "bits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("belief")).alias("p")).collect()
    return {kind: classifier(sorted((r["bits"], r["n"], r["p"]) for r in rows if r["kind"] == kind)) for kind in counts}


def _score(x: Column, weights: dict[str, list[float]]) -> Column:
    out = None
    for kind, w in weights.items():
        z = reduce(lambda a, kv: a + F.when(x["bits"].bitwiseAND(1 << kv[0]) != 0, kv[1]).otherwise(0.0), enumerate(w[:-1]), F.lit(w[-1]))
        out = F.when(x["kind"] == kind, z) if out is None else out.when(x["kind"] == kind, z)
    return out


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gazetteer: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base spans; spans has these and the loose candidates
    that the classifier takes to be personal data, as kind:start:end by kind, then start. A null text
    is empty, and null ids stay. Rows that repeat count each on its own; equal spans get equal decisions. Without
    any candidate there is nothing to learn and nothing is added; an empty table gives no rows. Further columns, of
    any name, are not read. ``gazetteer`` replaces lists of ``GAZETTEER``; each should stay within some thousand entries.
    """
    found = keep(candidates(docs, id_col, text_col, gazetteer), "candidates")
    weights = trained(found)
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    every = F.concat(plain("base"), plain(F.filter("loose", lambda x: _score(x, weights) > 0))) if weights else plain("base")
    is_of = lambda kind: lambda x: x["kind"] == kind
    ordered = F.concat(*(F.array_sort(F.filter(every, is_of(k))) for k in KINDS))
    counts = [F.size(F.filter("base", is_of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_shown(plain("base")).cast("binary"), 256).alias("base_sha256"), _shown(ordered).alias("spans"))
