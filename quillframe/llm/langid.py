"""Language identification by a bit-sliced Bloom filter of n-grams.

Every slot of the filter is a mask of languages, so one look-up of an n-gram
(the AND of its slots) tells all languages that have it. A text's score for a
language is the share of its n-grams that carry the language's bit, corrected
for the share that would by chance: ``(c / n - f) / (1 - f)`` with ``f`` the
language's filled slots to the power of the hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batches, crc_mod, mix, share

SLOTS = 1 << 20
HASHES = 2
#: Defaults of ``fit``: texts a language that the filter is fitted on (expected number of a hash sample), and n-grams kept of each language, the most frequent ones.
FIT_TEXTS, FIT_GRAMS = 1_500, 150_000
#: An n-gram counts for a language if this many of its texts have it, and this share of the rate of the language that has it most.
LEAST_TEXTS, LEAST_RATE = 2, 0.15
CHUNK = 1 << 21

#: ASCII other than letters becomes a space.
_TABLE = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all 4-byte grams of the texts, in order; where each text's begin). A text is framed by spaces."""
    raw = [b" " + t.lower().encode().translate(_TABLE) + b"  " for t in texts]
    whole = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    packed = whole[:-3] | whole[1:-2] << 8 | whole[2:-1] << 16 | whole[3:] << 24
    size = np.array([len(r) for r in raw], np.int64)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    inside = np.ones(len(whole), bool)
    for k in range(1, 4):
        inside[begin + size - k] = False
    return packed[inside[:-3]], np.r_[0, np.cumsum(size - 3)[:-1]]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Filter:
    langs: list[str]
    masks: np.ndarray  # (slots, words of 64 languages)
    chance: np.ndarray  # by language

    @staticmethod
    def slots(gram: np.ndarray) -> list[np.ndarray]:
        h = mix(gram.astype(np.uint64))
        return [((h >> np.uint64(32 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]

    @classmethod
    def build(cls, langs: list[str], gram: np.ndarray, lang: np.ndarray) -> Filter:
        masks = np.zeros((SLOTS, max(1, -(-len(langs) // 64))), np.uint64)
        for s in cls.slots(gram):
            np.bitwise_or.at(masks, (s, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
        filled = [float((masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) for k in range(len(langs))]
        return cls(langs, masks, np.array(filled) ** HASHES)

    def shares(self, texts: list[str]) -> np.ndarray:
        """Corrected shares, a row a text and a column a language."""
        gram, begin = grams(texts)
        slots, n = self.slots(gram), np.diff(np.r_[begin, len(gram)])
        out = np.zeros((len(texts), len(self.langs)))
        for w in range(self.masks.shape[1]):
            mask = self.masks[slots[0], w]
            for s in slots[1:]:
                mask &= self.masks[s, w]
            for k in range(64 * w, min(len(self.langs), 64 * w + 64)):
                out[:, k] = np.add.reduceat(mask >> np.uint64(k % 64) & np.uint64(1), begin)
        return np.clip((out / n[:, None] - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        start = 0
        while start < len(known):
            end, size = start, 0
            while end < len(known) and (end == start or size < CHUNK):
                size += len(texts[known[end]])
                end += 1
            share = self.shares([texts[i] for i in known[start:end]])
            best = share.argmax(axis=1)
            total = share.sum(axis=1)
            for i, row, k, t in zip(known[start:end], share, best, total):
                lang[i], score[i] = self.langs[k], float(row[k] / t) if t else 0.0
            start = end
        return lang, score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 0, folds: int = 5, fit_texts: int = FIT_TEXTS, fit_grams: int = FIT_GRAMS) -> Filter:
    """Learn from text and language of ids whose crc32 modulo ``folds`` is not ``held_out``; rows that lack one of them are not used.

    ``fit_texts`` and ``fit_grams`` are bounds for each language, so rare languages get as much room as common ones.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((crc_mod("id", folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Filter([], np.zeros((SLOTS, 1), np.uint64), np.zeros(0))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, fit_texts / n) * (1 << 24)))))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 24)) < share[F.col("lang")])

    def make():
        def step(batch):
            found, owner = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = np.unique(grams([text])[0])
                found.append(own)
                owner.append(np.full(len(own), langs.index(lang), np.uint64))
            both = np.concatenate(found).astype(np.uint64) << np.uint64(24) | np.concatenate(owner)
            key, n = np.unique(both, return_counts=True)
            return {"gram": key >> np.uint64(24), "lang": (key & np.uint64((1 << 24) - 1)).astype(np.int64), "n": n}

        return step

    held = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    counted = by_batches(sample.select("text", "lang"), make, "gram long, lang long, n long", whole=True).groupBy("gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    got = counted.withColumn("place", place).where(F.col("place") <= fit_grams).select("gram", "lang", "n").toPandas()
    got["rate"] = got["n"] / got["lang"].map(lambda k: held.get(langs[int(k)], 1))
    got = got[got["rate"] >= LEAST_RATE * got.groupby("gram")["rate"].transform("max")]
    return Filter.build(langs, got["gram"].to_numpy(np.int64).astype(np.uint32), got["lang"].to_numpy(np.int64))


def identified(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text", held_out: int = 0, folds: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter. Ties go to the
    language that sorts first. score is the chosen language's part of all corrected
    shares. held_out is null where the id is. Rows that repeat are judged alike; an empty table
    gives no rows; further columns, of any name, are not read.
    """
    shared = share(docs.sparkSession, model)

    def make():
        own = shared()

        def step(batch):
            lang, score = own.decide(batch.column(2).to_pylist())
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": lang, "score": pa.array(score, pa.float64())}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return by_batches(rows.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double")
