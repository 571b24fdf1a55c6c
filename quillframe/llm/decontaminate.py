"""Benchmark decontamination with an FM-index for each shard of the corpus.

Test items are cut into windows of ``WINDOW`` words. A shard (an Arrow batch of
documents) becomes one text of word numbers; words that no item has, and runs
too short or with word pairs of no window, cannot hold a window and shrink to
one separator. The rest is indexed: a suffix array, its Burrows-Wheeler
transform in a wavelet matrix, and the suffix positions sampled. All windows
are searched backward at once through wavelet ranks, occurrences are located by
walking to a sampled position, and their spans merged.

Items are collected in blocks of bounded size. Each block is one pass over the
documents, which are only read; what several passes find is merged by document,
so the test set may be of any size.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, fresh, keep, list_array, share, small

WINDOW = 13
#: Characters of test items searched for in one pass.
BLOCK_CHARS = 4_000_000
#: Rows up to which a table of documents with hits is broadcast.
BROADCAST_ROWS = 1_000_000
#: Every so many suffix positions are kept.
SAMPLE = 8
#: Slots of the table of word pairs.
PAIR_SLOTS = 1 << 22

_SPACES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split_words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_SPACES).split() if text else []


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(42)).astype(np.int64)


class Windows:
    """The distinct windows of some texts as rows of word numbers, and the items that hold each."""

    def __init__(self, texts: list[tuple[list[int], str | None]], width: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for items, text in texts:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in split_words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + width]), set()).update(items)
        self.items = [sorted(v) for v in found.values()]
        self.length = np.array([len(w) for w in found], np.int64)
        self.words = np.zeros((len(found), width), np.int32)
        for row, w in zip(self.words, found):
            row[: len(w)] = w
        self.least = int(self.length.min()) if len(found) else 0
        self.pairs = np.zeros(PAIR_SLOTS, bool)
        for w in found:
            a = np.array(w, np.int64)
            self.pairs[_pair_slot(a[:-1], a[1:])] = True

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, positions in ``text``) of the runs that may hold a window, each run closed by a 0."""
        joined = (text[:-1] > 0) & (text[1:] > 0)
        joined[joined] = self.pairs[_pair_slot(text[:-1][joined], text[1:][joined])]
        starts = np.flatnonzero((text > 0) & ~np.r_[False, joined])
        ends = np.flatnonzero((text > 0) & ~np.r_[joined, False]) + 1
        long = ends - starts >= self.least
        starts, ends = starts[long], ends[long]
        size = ends - starts + 1
        at = np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        symbols = text[np.minimum(at, len(text) - 1)]
        symbols[np.cumsum(size) - 1] = 0
        return symbols, at


class FMIndex:
    """Full-text index of a sequence of positive numbers in which 0 closes every run."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        n = len(text)
        order = self._suffixes(text)
        before = np.where(order > 0, text[order - 1], 0)
        counts = np.bincount(text, minlength=int(text.max()) + 2)
        self.first = np.r_[0, np.cumsum(counts)]
        self.bwt, self.n = before, n
        self.levels = []
        now = before
        for bit in range(int(text.max()).bit_length() - 1, -1, -1):
            ones = (now >> bit & 1).astype(bool)
            self.levels.append((bit, np.r_[0, np.cumsum(ones)].astype(np.int64), int(n - ones.sum())))
            now = np.r_[now[~ones], now[ones]]
        # a walk never crosses the start of a run
        self.sampled = (order % sample == 0) | (before == 0)
        self.position = np.where(self.sampled, order, -1)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling. Separators differ from each other, by position, so ties end with a run."""
        n, zero = len(text), text == 0
        rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum()))
        step = 1
        while True:
            follow = np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)]
            key = rank * (int(rank.max()) + 2) + follow
            order = np.argsort(key, kind="stable")
            new = np.r_[0, np.cumsum(np.diff(key[order]) > 0)]
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            step *= 2

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position of the transform."""
        low = np.zeros(len(symbol), np.int64)
        for bit, ones, zeros in self.levels:
            up = (symbol >> bit & 1).astype(bool)
            a, b = ones[low], ones[end]
            low, end = np.where(up, zeros + a, low - a), np.where(up, zeros + b, end - b)
        return end - low

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of ``words`` that occur, first row and end of their suffix range)."""
        live = np.flatnonzero(np.where(np.arange(words.shape[1]) < length[:, None], words, 0).max(axis=1) < len(self.first) - 2)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        done = []
        for k in range(words.shape[1]):
            over = length[live] == k
            done.append((live[over], low[over], high[over]))
            live, low, high = live[~over], low[~over], high[~over]
            c = words[live, length[live] - 1 - k]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        done.append((live, low, high))
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, at, steps, todo = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            hit = self.sampled[at]
            out[todo[hit]] = self.position[at[hit]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.bwt[at]
            at, steps = self.first[c] + self.rank(c, at), steps + 1
        return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def scan(docs: DataFrame, windows) -> DataFrame:
    """(doc_id, text, n_words, spans, items) of (doc_id, text): a block's occurrences; spans are flat pairs of word positions."""

    def make():
        block: Windows = windows()
        number = block.vocab.get

        def step(batch):
            ids, sizes = [], []
            for text in batch.column("text").to_pylist():
                w = split_words(text)
                sizes.append(len(w))
                ids.append(np.fromiter(map(number, w, [0] * len(w)), np.int64, len(w)))
                ids.append(np.zeros(1, np.int64))
            whole, sizes = np.concatenate(ids), np.array(sizes, np.int64)
            begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
            cover, held = np.zeros(len(whole) + 1, np.int64), {}
            symbols, place = block.candidates(whole) if len(block.items) else (whole[:0], whole[:0])
            if len(symbols):
                index = FMIndex(symbols)
                which, low, high = index.search(block.words, block.length)
                which = np.repeat(which, high - low)
                rows = np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low) + np.arange(len(which)) if len(which) else which
                at = place[index.locate(rows)]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + block.length[which], -1)
                doc = np.searchsorted(begin, at, "right") - 1
                for d, w in np.unique(np.stack([doc, which]), axis=1).T:
                    held.setdefault(int(d), set()).update(block.items[w])
            spans, items, none = [], [], np.zeros(0, np.int64)
            hit = np.cumsum(cover[:-1]) > 0
            for i in range(len(sizes)):
                a, b = _runs(hit[begin[i] : begin[i] + sizes[i]]) if i in held else (none, none)
                spans.append(np.stack([a, b], axis=1).ravel())
                items.append(np.array(sorted(held.get(i, ())), np.int64))
            return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": sizes, "spans": list_array(spans), "items": list_array(items)}

        return step

    return by_batches(docs, make, "doc_id long, text string, n_words long, spans array<long>, items array<long>")


def _merged(found: DataFrame) -> DataFrame:
    """One row a document (doc_id, hash) of what several blocks have found in it; spans that touch or overlap become one."""
    each = found.groupBy("doc_id", "hash").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def step(batch):
        spans = []
        for flat in batch.column("spans").to_pylist():
            out: list[int] = []
            for a, b in sorted(zip(flat[::2], flat[1::2])):
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], b)
                else:
                    out += [a, b]
            spans.append(np.array(out, np.int64))
        return {"doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "spans": list_array(spans), "items": batch.column("items")}

    return by_batches(each, lambda: step, "doc_id long, hash long, spans array<long>, items array<long>")


def occurrences(docs: DataFrame, bench: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, spans, items): where windows of test items occur in every row.

    A window is ``width`` consecutive words of an item (words of ``_WORD``, A-Z
    lower-cased), or all of an item with fewer. spans are flat pairs of word
    positions, end exclusive, merged and ascending; items are the item_ids, ascending.
    Null or wordless texts have no words. Items with a null id or no words are
    left out. Repeated rows and items count each on its own; further columns, of any name, are not read.
    """
    spark = docs.sparkSession
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    texts = items.groupBy("text").agg(F.collect_set("item_id").alias("ids"))
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // block_chars))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def block(k: int):
        own = [(r["ids"], r["text"]) for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()]
        return share(spark, Windows(own, width))

    if blocks == 1:
        return scan(rows, block(0))
    parts = [keep(scan(rows, block(k)).where(F.size("items") > 0).select("doc_id", F.xxhash64("text").alias("hash"), "spans", "items").distinct(), "found") for k in range(blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    hits = small(keep(_merged(every).withColumnRenamed("doc_id", "id"), "merged"), BROADCAST_ROWS)
    plain = scan(rows, share(spark, Windows([], width))).drop("spans", "items")
    none = F.expr("cast(array() as array<bigint>)")
    both = plain.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left")
    return both.select("doc_id", "text", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", none).alias("items"))


def _n_hit():
    return F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def _contaminated(hit):
    return (hit > 0) & (20 * hit >= F.col("n_words"))


def marked(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    contaminated: some word is hit, and at least one in twenty.
    """
    out = occurrences(docs, bench, **options).select("doc_id", "n_words", _n_hit().alias("n_hit"), "items")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit")).alias("contaminated"),
    )


def cut_spans(found: DataFrame) -> DataFrame:
    """(doc_id, text): the text of ``occurrences`` without the bytes from the first to the last word of each span."""

    def make():
        def step(batch):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if spans:
                    raw = text.encode()
                    at = [m.span() for m in _WORD.finditer(raw.lower())]
                    for a, b in reversed(list(zip(spans[::2], spans[1::2]))):
                        raw = raw[: at[a][0]] + raw[at[b - 1][1] :]
                    text = raw.decode()
                texts.append(text)
            return {"doc_id": batch.column("doc_id"), "text": texts}

        return step

    return by_batches(found.select("doc_id", "text", "spans"), make, "doc_id long, text string")


def decontaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, whole, but for the words that lie in windows, which are cut out.

    A text decides, whatever its id, so rows that repeat and rows with null ids are judged alike. Null and wordless
    texts stay. Rows without a hit stay as they are. An empty table stays empty; columns of any name may be there.
    """
    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = keep(occurrences(texts, bench, **options).where(F.size("items") > 0).withColumn("bad", _contaminated(_n_hit())), "hits")
    gone = hits.where("bad").select("doc_id", F.lit(None).cast("string").alias("text"))
    out, cut, mark = fresh(docs, "hash", "cut", "hit")
    found = keep(gone.union(cut_spans(hits.where("not bad"))).distinct(), "cut").toDF(out, cut).withColumn(mark, F.lit(True))
    both = docs.join(small(found, BROADCAST_ROWS), F.xxhash64(F.col(text_col).cast("string")) == F.col(out), "left")
    return both.where(F.col(mark).isNull() | F.col(cut).isNotNull()).withColumn(text_col, F.coalesce(F.col(cut), F.col(text_col))).select(docs.columns)
