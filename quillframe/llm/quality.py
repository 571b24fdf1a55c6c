"""Quality rules as a learned decision list.

Each text is measured once. Sequential covering then learns, from labelled
measurements, an ordered list of conjunctions of thresholds that describe
rejected text: a rule is grown by the condition of most information gain, cut
back on rows it did not see, and kept while it is precise there; the rows it
covers go, and the next one is grown. The list becomes one ordered ``CASE WHEN``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, WordHash, by_batches, fresh, keep, mix

#: Labelled rows that the list is fitted on, at most (expected number of a hash sample).
FIT_ROWS = 50_000
#: Least precision and cover of a rule on rows it was not grown on.
PRECISION, COVER = 0.95, 8
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 64

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: What conditions are about, from the measurements.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a 3-word window found at least twice, its first finding included."""
    if len(words) < 4:
        return 0
    key = mix(mix(mix(words[:-2]) + words[1:-1]) + words[2:])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    cover = np.zeros(len(words) + 1, np.int64)
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + 3, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(texts: list[str | None], hashes: WordHash) -> dict[str, list[int]]:
    rows = []
    for text in texts:
        raw = (text or "").encode()
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
        rows.append((len(words), len(raw.translate(None, _SPACE).decode()), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(hashes.many(words))))
    return {k: list(v) for k, v in zip(MEASURES, zip(*rows))} if rows else {k: [] for k in MEASURES}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and the measurements of the whole text (a null one has none).

    n_words, word_chars (code points in words), n_symbols, n_lines (with a word), n_dup_lines
    (with a word, equal to an earlier line), n_repeat_words (see ``repeated_words``).
    """

    def make():
        hashes = WordHash()
        return lambda batch: {"doc_id": batch.column(0)} | measure(batch.column(1).to_pylist(), hashes)

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES)
    return by_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.above else x[self.feature] < self.cut

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<'} {self.cut!r}D"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gain of a condition that leaves p of p0 rejected and n of n0 other rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and bad[live].any() and not bad[live].all():
        p0, n0 = int(bad[live].sum()), int((~bad[live]).sum())
        best: tuple[float, Condition | None] = (1e-9, None)
        for name, values in x.items():
            v, b = values[live], bad[live]
            cuts = np.unique(np.quantile(v[b], np.linspace(0, 1, CUTS), method="nearest"))
            order = np.argsort(v, kind="stable")
            below = np.searchsorted(v[order], cuts, "left")
            p_below = np.r_[0, np.cumsum(b[order])][below]
            for above, p, n in ((True, p0 - p_below, n0 - (below - p_below)), (False, p_below, below - p_below)):
                gains = _gain(p0, n0, p, n)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (float(gains[k]), Condition(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].holds(x)
    return tuple(rule)


def _precision(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    hit = covers(rule, x)
    return float((bad[hit].sum() + 1) / (hit.sum() + 2)), int(hit.sum())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """The ordered rules that describe rejected rows; none where one class lacks."""
    rules: list[Rule] = []
    deal = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    live = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grown, kept = live & deal, live & ~deal
        if not bad[grown].any() or bad[grown].all() or not bad[kept].any():
            break
        rule = _grow({k: v[grown] for k, v in x.items()}, bad[grown])
        held, truth = {k: v[kept] for k, v in x.items()}, bad[kept]
        tails = [rule[:k] for k in range(1, len(rule) + 1)]
        if not tails:
            break
        # the shortest of the best: cut conditions that do not help on rows not seen
        rule = max(tails, key=lambda r: (round(_precision(r, held, truth)[0], 3), -len(r)))
        precise, cover = _precision(rule, held, truth)
        if precise < PRECISION or cover < COVER:
            break
        rules.append(rule)
        live &= ~covers(rule, x)
    return rules


def decision(rules: list[Rule]) -> Column:
    """The list as one conditional expression: true where the text is kept."""
    if not rules:
        return F.lit(True)
    return F.expr("case " + " ".join(f"when {' and '.join(f'({c.sql()})' for c in r)} then false" for r in rules) + " else true end")


def labelled(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """A hash sample of about ``rows`` labelled ids (doc_id, quality); rows with a null id or label are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    share = min(1.0, rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(measures: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from ``labels`` (doc_id, quality: 0 is rejected), on ``labelled`` of them."""
    got = measures.join(F.broadcast(labelled(labels, rows)), "doc_id").select("quality", *(F.expr(e).alias(k) for k, e in FEATURES.items())).where("n_words >= 50").toPandas()
    got = got.sort_values([*FEATURES, "quality"], kind="stable")
    return learn({k: got[k].to_numpy(np.float64) for k in FEATURES}, got["quality"].to_numpy() == 0)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the measurements, base_failed and kept.

    A text with under 50 words, or with over half of its words in repeated
    3-word windows, fails whatever the list says; the list judges the others. Ties and
    repeated rows are judged alike. Without labels of both kinds the list is empty and keeps all.
    """
    measures = keep(measured(docs, id_col, text_col), "measures")
    rules = fit(measures, labels)
    return measures.select("*", base_failed().alias("base_failed"), (~base_failed() & decision(rules)).alias("kept"))


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose text is kept. Every row is judged by its own text, whatever its id.

    Null and wordless texts fail the base rules and go; rows that repeat are judged alike; an empty table stays
    empty; columns of any name may be there.
    """
    known, row, found = fresh(docs, "known", "row", "measures")
    some = docs.join(F.broadcast(labelled(labels).select(F.col("doc_id").alias(known)).distinct()), F.col(id_col).cast("long") == F.col(known), "left_semi")
    rules = fit(measured(some, id_col, text_col), labels)

    @F.pandas_udf(", ".join(f"{k} long" for k in MEASURES))
    def measures(texts: pd.Series) -> pd.DataFrame:
        some = (texts.iloc[k : k + SLICE_ROWS].tolist() for k in range(0, max(1, len(texts)), SLICE_ROWS))
        return pd.concat([pd.DataFrame(measure(part, WordHash()), columns=list(MEASURES), dtype="int64") for part in some], ignore_index=True)

    judged_rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), measures(F.col(text_col).cast("string")).alias(found)).select(row, f"{found}.*")
    return judged_rows.where(~base_failed() & decision(rules)).select(f"{row}.*")
