"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts are turned into sets of hashed words.
The words whose share differs most between the two are the inputs of a linear
classifier, trained in numpy under the non-negative risk estimate
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``: what unlabelled text loses
as negative is corrected by the share of toxic text it must hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, by_batches, crc_mod, list_array, share
from .decontaminate import split_words

SLOTS = 1 << 18
#: Defaults of ``fit``: sizes of the fitted samples (expected numbers of hash samples of the toxic and of all texts), and inputs of the classifier.
POSITIVES, UNLABELLED = 5_000, 15_000
INPUTS = 512
#: Bounds of the prior: the risk estimate needs one above 0, and under one half so that toxic text is the rarer class.
PRIORS = 1e-3, 0.5
#: Least z score of an input, and positives that have it.
LEAST_Z, LEAST_TEXTS = 3.0, 4
THRESHOLD = 0.7


def _slots(text: str | None, hashes: WordHash) -> np.ndarray:
    return np.unique(hashes.many(list(set(split_words(text)))) % np.uint64(SLOTS)).astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def score(self, text: str | None, hashes: WordHash) -> float:
        z = self.bias + float(self.weight[_slots(text, hashes)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def word_sets(texts: DataFrame) -> list[np.ndarray]:
    """The hashed word sets of a bounded sample, on the driver, in an order that does not depend on partitions.

    Copies count once, so that a group of them does not pass for evidence.
    """

    def make():
        hashes = WordHash()
        return lambda batch: {"id": batch.column(0), "slots": list_array([_slots(t, hashes) for t in batch.column(1).to_pylist()], np.int32)}

    got = by_batches(texts, make, "id long, slots array<int>").orderBy("id").toArrow()
    sets = (np.array(v, np.int32) for v in got.column("slots").to_pylist())
    return list({v.tobytes(): v for v in sets}.values())


def _dense(sets: list[np.ndarray], place: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(sets), width), np.float32)
    for row, s in zip(out, sets):
        at = place[s]
        row[at[at >= 0]] = 1
    return out


def risk(x_p: np.ndarray, x_u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, slope) of the estimated risk of a linear classifier; the slope is of w, then b.

    The logistic loss of toxic texts as toxic counts ``prior`` times. The negative part is the loss of unlabelled texts as
    harmless less ``prior`` times that of toxic ones; where it falls below zero, the slope is that of undoing it alone.
    """
    loss = lambda t: np.logaddexp(0, -t)
    slope = lambda t: -1 / (1 + np.exp(np.clip(t, -50, 50)))
    n_p, n_u = len(x_p), len(x_u)
    f_p, f_u = x_p @ w + b, x_u @ w + b
    positive, negative = prior * loss(f_p).mean(), loss(-f_u).mean() - prior * loss(-f_p).mean()
    g_p, g_u = slope(-f_p) * prior / n_p, -slope(-f_u) / n_u
    if negative >= 0:
        g_p = g_p + prior * slope(f_p) / n_p
    else:
        g_p, g_u = -g_p, -g_u
    return float(positive), float(negative), np.r_[x_p.T @ g_p + x_u.T @ g_u, g_p.sum() + g_u.sum()]


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4, inputs: int = INPUTS) -> Model:
    """Fit by Adam on the whole sample. Without positives or unlabelled texts every score is ``prior``."""
    weight = np.zeros(SLOTS, np.float64)
    prior = min(max(prior, PRIORS[0]), PRIORS[1])
    if not positive or not unlabelled:
        return Model(weight, float(np.log(prior / (1 - prior))))
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(np.concatenate(positive), minlength=SLOTS)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=SLOTS)
    mean = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u))
    chosen = np.argsort(-np.abs(z), kind="stable")[:inputs]
    chosen = chosen[(np.abs(z[chosen]) >= LEAST_Z) & (in_p[chosen] >= LEAST_TEXTS)]
    place = np.full(SLOTS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    x_p, x_u = _dense(positive, place, len(chosen)), _dense(unlabelled, place, len(chosen))
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        grad = risk(x_p, x_u, w, b, prior)[2] + decay * np.r_[w, 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weight[chosen] = w
    return Model(weight, float(b) + threshold_shift(x_p @ w + b, x_u @ w + b, prior))


def threshold_shift(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> float:
    """What to add to the bias so that ``THRESHOLD`` falls where recall squared over the share of unlabelled text above is greatest.

    That ratio grows with the F score, and needs no negatives. Above any cut there should be at least the prior's part of the recall.
    """
    cuts = np.unique(np.quantile(f_p, np.linspace(0, 1, 200)))
    recall = 1 - np.searchsorted(np.sort(f_p), cuts) / len(f_p)
    above = 1 - np.searchsorted(np.sort(f_u), cuts) / len(f_u)
    best = int(np.argmax(recall**2 / np.maximum(above, np.maximum(prior * recall, 1 / len(f_u)))))
    lower = f_u[f_u < cuts[best]]
    middle = (cuts[best] + (lower.max() if len(lower) else cuts[best])) / 2
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - middle)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, folds: int = 3, positives: int = POSITIVES, unlabelled: int = UNLABELLED, inputs: int = INPUTS) -> Model:
    """Learn from ids whose crc32 modulo ``folds`` is not ``held_out``; only ``labels.toxic`` of those is read.

    Positives are a hash sample of the toxic ids; unlabelled texts are a hash sample of all of them, labels unseen.
    The prior is the share of toxic among the labels. ``positives`` and ``unlabelled`` bound the samples, ``inputs`` the
    words of the classifier: they bound the driver's memory, whatever the corpus, and can be raised with it.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where((crc_mod("id", folds) != held_out) & F.col("text").isNotNull())
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null").where(crc_mod("id", folds) != held_out)
    count = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    part = lambda seed, share: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 24)) < int(min(1.0, share) * (1 << 24))
    toxic = known.where("toxic = 1").where(part(1, positives / max(1, count["p"]))).select("id").distinct()
    marked = word_sets(texts.join(F.broadcast(toxic), "id"))
    others = word_sets(texts.where(part(2, unlabelled / max(1, texts.count()))))
    return train(marked, others, count["p"] / max(1, count["n"]), inputs=inputs)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, folds: int = 3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no words and get the score of none. held_out is null where the id is. Rows that
    repeat, and ties, are scored alike; an empty table gives no rows; further columns, of any name, are not read.
    """
    shared = share(docs.sparkSession, model)

    def make():
        hashes, own = WordHash(), shared()
        return lambda batch: {"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array([own.score(t, hashes) for t in batch.column(2).to_pylist()], pa.float64())}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = by_batches(rows.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
