"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Equal sets form a class, led by its first line.
Words are ordered from rare to common, by counts over all lines; two lines
whose Jaccard similarity reaches the threshold share a word among the rarest few of
both (prefix filter). Under such a word only lines pass whose sizes are close
(length filter), whose places of the word leave enough words to share
(positional filter), and whose parities, of 64 bits or for longer lines 128,
differ in no more bits than words may. What passes is verified on the words.

A line goes if an earlier line is similar, earlier by (doc_id, line number).
First each line is verified against the few that pass with the nearest parities
under its words; lines still standing that had more to choose from are
verified against all, so a line with thousands of variants costs a few pairs a
variant, and none is missed.

A word that very many lines have among their rarest is dealt to many tasks: its
lines fall into cells of like size and place, cells into parts of bounded size, and
a task has two parts of cells between which sizes and places allow a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import by_batches, fresh, groups_of, keep, mix, rows_under, small, tidy

#: Least distinct words of a line that is compared: every line with a word.
LEAST_WORDS = 1
#: Slots of the table of word counts, at every size: in a large corpus rare words share them, which blurs the order and loses nothing.
SLOTS = 1 << 16
#: Lines under a word from which it is dealt in parts, of the least and most lines. A word is known by one line of every ``GLANCE``.
GROUP, PART, GLANCE = 2_048, (1_024, 16_384), 16
BROADCAST_ROWS = 2_000_000
#: Words from which a line's parity has 128 bits.
LONG = 48
#: Partners of a line verified first: taken under each prefix word, and tried of those under all.
NEAREST, TRIED = 4, 8
#: Characters, and pairs, handled at once in a task.
CHUNK = 250_000
#: Bytes of a word that are hashed eight at a time.
PLACES = 64

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: The bits of so many bytes.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(texts as bytes, all bytes, where words begin there, 64-bit hashes) of all words of whole texts, A-Z lower-cased, split at ASCII white space.

    A hash mixes in eight bytes after eight, beginning with the size; words of over ``PLACES`` bytes take another hash.
    """
    each = [(t or "").encode() for t in texts]
    whole = b"\n".join(each).lower()
    eights = np.frombuffer(whole + bytes(16 - len(whole) % 8), "<u8")
    raw = eights.view(np.uint8)[: len(whole)]
    inner = np.zeros(len(raw) + 2, bool)
    inner[1:-1] = (raw != 32) & (raw - np.uint8(9) > 4)
    edge = np.flatnonzero(inner[1:] != inner[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return each, raw, start, np.zeros(0, np.uint64)

    def bytes_at(place, left):
        at, shift = place >> 3, (place & 7).astype(np.uint64) << np.uint64(3)
        both = eights[at] >> shift | eights[at + 1] << (np.uint64(63) - shift) << np.uint64(1)
        return both & _BYTES[np.minimum(left, 8)]

    h = mix(size.astype(np.uint64) * _SPREAD ^ bytes_at(start, size))
    more = np.flatnonzero(size > 8)
    for done in range(8, PLACES, 8):
        more = more[size[more] > done]
        if not len(more):
            break
        h[more] = mix(h[more] ^ bytes_at(start[more] + done, size[more] - done))
    for k in np.flatnonzero(size > PLACES):
        h[k] = xxhash.xxh64_intdigest(raw[start[k] : start[k] + size[k]].tobytes())
    return each, raw, start, h


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, line number, hash) of all words of whole texts."""
    each, raw, start, h = _words(texts)
    begin, breaks = np.cumsum([0, *(len(x) + 1 for x in each[:-1])]), np.flatnonzero(raw == 10)
    # words, texts and lines stand in one order: how many words are in each tells their numbers
    text = np.repeat(np.arange(len(begin)), np.diff(np.r_[np.searchsorted(start, begin), len(start)]))
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.r_[0, np.searchsorted(start, breaks), len(start)]))
    return text, line - np.searchsorted(breaks, begin)[text], h


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Texts a few at a time, with the number of the first."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and size < CHUNK:
            size += len(texts[end] or "")
            end += 1
        yield start, texts[start:end]
        start = end


def word_counts(rows: DataFrame, slots: int) -> np.ndarray:
    """How often words of each slot of hashes occur in all texts; counted in tasks, summed by slot."""

    def step(batch):
        n = np.zeros(slots, np.int64)
        for _, texts in chunks(batch.column("text").to_pylist()):
            n += np.bincount((_words(texts)[-1] & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(n)
        return {"slot": at, "n": n[at]}

    got = by_batches(rows.select("text"), lambda: step, "slot long, n long", whole=True).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(slots, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return counts


def levels(counts: np.ndarray) -> np.ndarray:
    """The logarithms of counts, as the top bits of codes."""
    return np.ceil(np.log2(np.maximum(counts, 1))).astype(np.uint64) << np.uint64(58)


@dataclass
class Lines:
    """Lines with a word: text and line numbers, and the distinct word codes of all, ascending within each line."""

    text: np.ndarray
    line: np.ndarray
    words: np.ndarray
    begin: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(np.r_[self.begin, len(self.words)])

    @cached_property
    def mixed(self) -> np.ndarray:
        return mix(self.words)

    def pick(self, wanted: np.ndarray) -> Lines:
        if wanted.all():
            return self
        size = self.size
        begin = np.r_[0, np.cumsum(size[wanted])[:-1]] if wanted.any() else np.zeros(0, np.int64)
        return Lines(self.text[wanted], self.line[wanted], self.words[np.repeat(wanted, size)], begin)

    def signatures(self) -> np.ndarray:
        return mix(np.add.reduceat(self.mixed, self.begin) + self.size.astype(np.uint64)).view(np.int64)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """For each of 64 bits whether an odd number of words falls there; and the same of half of the words, for lines of ``LONG`` words."""
        h = self.mixed
        bit = np.uint64(1) << (h >> np.uint64(58))
        half = np.bitwise_xor.reduceat(np.where(h & np.uint64(1), bit, np.uint64(0)), self.begin)
        return np.bitwise_xor.reduceat(bit, self.begin), np.where(self.size >= LONG, half, np.uint64(0))

    def prefixes(self, percent: int) -> pa.Array:
        """Each line's rarest words as (key of 32 bits, place)."""
        size = self.size
        at = np.arange(len(self.words)) - np.repeat(self.begin, size)
        front = at < np.repeat(np.where(has_partners(size, percent), prefix_size(size, percent), 0), size)
        packed = (self.mixed[front] >> np.uint64(33)) << np.uint64(32) | at[front].astype(np.uint64)
        ends = np.r_[0, np.cumsum(np.bincount(np.repeat(np.arange(len(size)), size)[front], minlength=len(size)))]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(packed.view(np.int64)))


def prefix_size(n, percent: int):
    """Rarest words of a set of n among which any similar set has one."""
    return n + percent * -n // 100 + 1


def has_partners(n, percent: int):
    """Whether a set of n may be similar to another than itself: sets so small that one word is too much have equals alone."""
    return (100 * n // percent > n) | (n + percent * -n // 100 > 0)


def _sorted_sets(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of each run, ascending: (which run, codes, beginnings). Runs are sorted as rows of tables of like width."""
    begin, kinds = np.cumsum(size) - size, np.ceil(np.log2(size) * 2).astype(np.int64)
    runs, flat, sizes = [], [], []
    for k in np.unique(kinds):
        own = np.flatnonzero(kinds == k)
        width = int(size[own].max())
        filled = np.arange(width) < size[own][:, None]
        table = np.full(filled.shape, np.iinfo(np.uint64).max, np.uint64)
        table[filled] = codes[np.repeat(begin[own] - np.r_[0, np.cumsum(size[own])[:-1]], size[own]) + np.arange(size[own].sum())]
        table.sort(axis=1)
        new = filled.copy()
        new[:, 1:] &= table[:, 1:] != table[:, :-1]
        runs.append(own)
        flat.append(table[new])
        sizes.append(new.sum(axis=1))
    n = np.concatenate(sizes)
    return np.concatenate(runs), np.concatenate(flat), np.cumsum(n) - n


def lines_of(texts: list[str | None], level: np.ndarray) -> Iterator[Lines]:
    """Lines of whole texts, some at a time. A word's code is the logarithm of its count, then its hash: codes sort from rare to common."""
    for start, some in chunks(texts):
        text, line, h = hashed_words(some)
        if len(h):
            code = level[(h & np.uint64(len(level) - 1)).astype(np.int64)] | h >> np.uint64(6)
            begin = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (line[1:] != line[:-1])])
            run, flat, starts = _sorted_sets(code, np.diff(np.r_[begin, len(h)]))
            yield Lines(start + text[begin][run], line[begin][run], flat, starts)


def line_sets(rows: DataFrame, counts, percent: int, least: int) -> DataFrame:
    """(sig, doc_id, place, bits, half, again, prefix) of every line with at least ``least`` words; place holds the line's number above its size, again tells whether an earlier line of its text has the same words."""
    names = ("sig", "doc_id", "place", "bits", "half", "again", "prefix")

    def repeated(sig, lines):
        order = np.lexsort((lines.line, sig, lines.text))
        sig, text, again = sig[order], lines.text[order], np.zeros(len(sig), bool)
        again[order[1:]] = (sig[1:] == sig[:-1]) & (text[1:] == text[:-1])
        return again

    def make():
        level = levels(counts.value)

        def step(batch):
            ids, out = batch.column("doc_id").to_numpy(), []
            for lines in lines_of(batch.column("text").to_pylist(), level):
                lines = lines.pick(lines.size >= least)
                if len(lines.line):
                    sig = lines.signatures()
                    out.append((sig, ids[lines.text], lines.line << 32 | lines.size, *lines.parities(), repeated(sig, lines), lines.prefixes(percent)))
            if not out:
                return None
            return {k: pa.concat_arrays(v) if k == "prefix" else np.concatenate(v) for k, v in zip(names, zip(*out))}

        return step

    return by_batches(rows.select("doc_id", "text"), make, "sig long, doc_id long, place long, bits long, half long, again boolean, prefix array<long>")


def dealt(firsts: DataFrame) -> DataFrame:
    """A row a line and prefix word: (doc_id, place, bits, half, p), p the word's key above its place in the line."""
    return firsts.select("doc_id", "place", "bits", "half", F.explode("prefix").alias("p"))


def number(place: str = "place"):
    return F.shiftright(place, 32).cast("int")


def _spread(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each number as often as its count says, and how often it was there before; some at a time."""
    done, total = 0, np.r_[0, np.cumsum(count)]
    while done < len(count):
        upto = max(done + 1, int(np.searchsorted(total, total[done] + CHUNK, "right")) - 1)
        c = count[done:upto]
        yield np.repeat(np.arange(done, upto), c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        done = upto


def _close(key: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a key, the first no larger than the second, whose sizes and places leave enough words to share. Some at a time.

    Rows are sorted by key, size and place. A row meets runs of one size, and of each its first places alone: other pairs are never made.
    """
    if not len(key):
        return
    both = key.astype(np.int64) << 32 | n
    begin = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    run = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(key)]))
    placed = run << 32 | at
    top = np.minimum(100 * n // percent, np.maximum((n - at) * (100 + percent) // percent - n, 0))
    runs = np.where(top < n, 0, np.searchsorted(both[begin], key.astype(np.int64) << 32 | top, "right") - run)
    for i, more in _spread(runs):
        r = run[i] + more
        m = n[begin[r]]
        last = m + -percent * (n[i] + m) // (100 + percent)
        start = np.maximum(begin[r], i + 1)
        count = np.where(last < 0, 0, np.maximum(np.searchsorted(placed, r << 32 | np.maximum(last, 0), "right") - start, 0))
        for k, j in _spread(count):
            yield i[k], start[k] + j


def _cell(n, at) -> list:
    """Size and place of a row, coarser the larger they are: (name, column)."""
    size = F.when(n <= 32, n).otherwise(32 + F.floor(F.log(n / 32) / F.log(F.lit(1.05))))
    place = F.when(at <= 8, at).otherwise(8 + F.floor(F.log(at / 8) / F.log(F.lit(1.25))))
    return [size.cast("int").alias("size"), place.cast("int").alias("spot")]


def in_parts(rows: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """``rows`` under the words in ``hot`` (key), once for each pair of parts they belong to, with grp and side: 1 and 2 are paired with each other, 0 with one another.

    Two cells meet if sizes and places in them leave enough words to share.
    """
    key, n, at = F.shiftright("p", 32), F.col("place").bitwiseAND(0xFFFFFFFF), F.col("p").bitwiseAND(0xFFFFFFFF)
    own = keep(rows.withColumn("key", key).join(small(hot, BROADCAST_ROWS), "key", "left_semi").select("*", *_cell(n, at)), "hot-rows")
    cells = own.groupBy("key", "size", "spot").agg(F.count("*").alias("rows"), F.min(n).alias("low"), F.max(n).alias("high"), F.min(at).alias("first"))
    least, most = PART
    cells = keep(cells.withColumn("parts", F.ceil(F.col("rows") / F.least(F.greatest(F.col("rows") / 8, F.lit(least)), F.lit(most))).cast("int")), "cells")
    other = cells.select("key", *(F.col(c).alias(f"o_{c}") for c in ("size", "spot", "low", "high", "first", "parts")))
    fits = lambda a, b: 100 * F.col(f"{a}high") - (100 + percent) * F.col(f"{a}first") >= percent * F.col(f"{b}low")
    meets = cells.join(other, "key").where(fits("", "o_") & fits("o_", ""))
    partners = meets.groupBy("key", "size", "spot", "parts").agg(F.collect_list(F.struct("o_size", "o_spot", "o_parts")).alias("others"))
    placed = own.join(small(keep(partners, "cell-pairs"), BROADCAST_ROWS), ["key", "size", "spot"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "place"), "parts").cast("int")).select("*", F.explode("others").alias("o"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("o.o_parts") - 1)).alias("o_part"))
    mine, theirs = F.struct("size", "spot", "part"), F.struct(F.col("o.o_size").alias("size"), F.col("o.o_spot").alias("spot"), F.col("o_part").alias("part"))
    side = F.when(mine == theirs, 0).when(mine < theirs, 1).otherwise(2).alias("side")
    return placed.select(*rows.columns, F.xxhash64("key", F.least(mine, theirs), F.greatest(mine, theirs)).alias("grp"), side)


def candidates(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of lines, a earlier than b, that pass the filters under some prefix word: (a_doc, a_line, b_doc, b_line, more).

    Not ``every``: for each later line the ``TRIED`` nearest by parity of the ``NEAREST`` under each word; ``more`` tells whether others pass too.
    Else all pairs whose later line has ``asks``.
    """
    names = ("a_doc", "a_line", "b_doc", "b_line", "more", "far")

    def nearest(a, b, far):
        order = np.lexsort((a, far, b))
        a, b, far = a[order], b[order], far[order]
        starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else b
        few = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)])) < NEAREST
        return a[few], b[few], far[few]

    def found(table, grp, side):
        """Pairs within groups of rows."""
        place, p = table.column("place").to_numpy(), table.column("p").to_numpy()
        # rows come by group, size and place
        order = np.lexsort((p & 0xFFFFFFFF, place & 0xFFFFFFFF, grp))
        doc, bits, half = (table.column(c).to_numpy()[order] for c in ("doc_id", "bits", "half"))
        p, place, grp, bits, half = p[order], place[order], grp[order], bits.view(np.uint64), half.view(np.uint64)
        side = side[order] if side is not None else None
        key, at, line, n = np.cumsum(np.diff(grp, prepend=grp[:1]) != 0), p & 0xFFFFFFFF, place >> 32, place & 0xFFFFFFFF
        asks = table.column("asks").to_numpy(zero_copy_only=False)[order] if every else None
        passed, kept = np.zeros(len(key), np.int64), [(np.zeros(0, np.int64),) * 3]
        for i, j in _close(key, n, at, percent):
            if side is not None:
                apart = (side[i] == 0) | (side[i] != side[j])
                i, j = i[apart], j[apart]
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            most, differ = n[i] + n[j] - 2 * need, bits[i] ^ bits[j]
            ok = np.bitwise_count(differ) <= most
            i, j, differ, most = i[ok], j[ok], differ[ok], most[ok]
            part = half[i] ^ half[j]
            far = np.where((n[i] < LONG) | (n[j] < LONG), np.bitwise_count(differ), np.bitwise_count(part).astype(np.int64) + np.bitwise_count(differ ^ part))
            ok = (far <= most) & ((doc[i] != doc[j]) | (line[i] != line[j]))
            i, j, far = i[ok], j[ok], far[ok].astype(np.int64)
            swap = (doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j]))
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            if every:
                kept.append((a[asks[b]], b[asks[b]], far[asks[b]]))
            else:
                np.add.at(passed, b, 1)
                kept.append(nearest(a, b, far))
        a, b, far = (np.concatenate(x) for x in zip(*kept))
        if not every:
            a, b, far = nearest(a, b, far)
        columns = (doc[a], line[a].astype(np.int32), doc[b], line[b].astype(np.int32), passed[b] > NEAREST, far.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))

    def whole(batches):
        for table in groups_of(batches, "p", lambda p: p >> 32):
            yield found(table, table.column("p").to_numpy() >> 32, None)

    def parted(batches):
        for table in groups_of(batches, "grp"):
            yield found(table, table.column("grp").to_numpy(), table.column("side").to_numpy())

    shape, key = "a_doc long, a_line int, b_doc long, b_line int, more boolean, far int", F.shiftright("p", 32)
    glance = rows.where(F.pmod(F.xxhash64("doc_id", "place"), F.lit(GLANCE)) == 0).groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    hot = keep(glance.where(F.col("n") * GLANCE >= GROUP).select("key"), "hot-words")
    more = None
    if not rows_under(hot, 0):
        more = in_parts(rows, hot, percent).repartition("grp").sortWithinPartitions("grp").mapInArrow(tidy(parted), shape)
        rows = rows.join(small(hot, BROADCAST_ROWS), key == F.col("key"), "left_anti")
    pairs = rows.repartition(key).sortWithinPartitions("p").mapInArrow(tidy(whole), shape)
    pairs = pairs.union(more) if more is not None else pairs
    if every:
        return pairs.groupBy(*names[:4]).agg(F.max("more").alias("more"))
    own = Window.partitionBy("b_doc", "b_line")
    each = pairs.repartition("b_doc", "b_line").groupBy(*names[:4]).agg(F.max("more").alias("more"), F.min("far").alias("far"))
    ranked = each.withColumns({"rank": F.row_number().over(own.orderBy("far", "a_doc", "a_line")), "more": F.max("more").over(own) | (F.count("*").over(own) > TRIED)})
    return ranked.where(F.col("rank") <= TRIED).select(*names[:5])


def word_sets(rows: DataFrame, counts, wanted: DataFrame) -> DataFrame:
    """(doc_id, line, words) of the lines in ``wanted`` (doc_id, line); rows that repeat an id give one of each."""
    few = rows_under(wanted, BROADCAST_ROWS)
    lines = wanted.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    texts = rows.join(F.broadcast(lines) if few else lines, "doc_id").select("doc_id", "text", "lines")

    def make():
        level = levels(counts.value)

        def step(batch):
            ids, doc, no, sets = batch.column("doc_id").to_numpy(), [], [], []
            texts = [
                "\n".join(line if i in chosen else "" for i, line in enumerate((t or "").split("\n")))
                for t, chosen in zip(batch.column("text").to_pylist(), map(set, batch.column("lines").to_pylist()))
            ]
            for lines in lines_of(texts, level):
                doc.append(ids[lines.text])
                no.append(lines.line)
                sets += [w.tobytes() for w in np.split(lines.words, lines.begin[1:])]
            return {"doc_id": np.concatenate(doc), "line": np.concatenate(no), "words": sets} if doc else None

        return step

    return by_batches(texts, make, "doc_id long, line int, words binary").dropDuplicates(["doc_id", "line"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with alike: whether the words reach the threshold."""
    side = lambda x: sets.withColumnsRenamed({"doc_id": f"{x}_doc", "line": f"{x}_line", "words": f"{x}_words"})
    both = pairs.join(side("b"), ["b_doc", "b_line"]).join(side("a"), ["a_doc", "a_line"])

    def step(batch):
        both = [u + v for u, v in zip(*(batch.column(c).to_pylist() for c in ("a_words", "b_words")))]
        size = np.array([len(w) // 8 for w in both], np.int64)
        run, words, begin = _sorted_sets(np.frombuffer(b"".join(both), np.uint64), size)
        union = np.zeros(len(both), np.int64)
        union[run] = np.diff(np.r_[begin, len(words)])
        shared = size - union
        return {c: batch.column(c) for c in ("a_doc", "a_line", "b_doc", "b_line")} | {"alike": 100 * shared >= percent * union}

    return by_batches(both.select("a_doc", "a_line", "b_doc", "b_line", "a_words", "b_words"), lambda: step, "a_doc long, a_line int, b_doc long, b_line int, alike boolean")


def similar_earlier(docs: DataFrame, percent: int = 80, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line) of every line that goes: an earlier line, by (doc_id, line), is at least ``percent`` similar."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    counts = docs.sparkSession.sparkContext.broadcast(word_counts(rows, SLOTS))

    # random numbers that no dictionary of a file makes smaller
    lines = keep(line_sets(rows, counts, percent, least), "lines", **{"parquet.enable.dictionary": "false"})
    # within a text Python has told repeats; of equal lines of several texts only the few with more than one need to be joined
    once = lines.where(~F.col("again")).select("sig", "doc_id", "place")
    shared = keep(once.groupBy("sig").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("sig", "lead"), "shared-lines")
    elsewhere = once.join(small(shared, BROADCAST_ROWS), "sig").where("doc_id <> lead")
    repeats = keep(lines.where("again").select("doc_id", "place").union(elsewhere.select("doc_id", "place")).distinct(), "repeats")
    firsts = lines.drop("sig", "again").join(small(repeats, BROADCAST_ROWS), ["doc_id", "place"], "left_anti")

    later = ["b_doc", "b_line"]
    near = keep(candidates(dealt(firsts), percent, every=False), "near")

    def sets_of(pairs):
        both = pairs.select(F.col("a_doc").alias("doc_id"), F.col("a_line").alias("line")).union(pairs.select(*later)).distinct()
        return keep(word_sets(rows, counts, keep(both, "wanted")), "word-sets")

    tried = keep(verified(near.drop("more"), sets_of(near), percent), "tried")
    matched = tried.where("alike").select(*later).distinct()
    gone = matched.select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line"))
    # lines that others might still match
    left = near.where("more").select(*later).distinct().join(matched, later, "left_anti")
    left = keep(left.select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line"), F.lit(True).alias("asks")), "open-lines")
    if not rows_under(left, 0):
        asked, size = small(left, BROADCAST_ROWS), F.col("place").bitwiseAND(0xFFFFFFFF)
        numbered = firsts.withColumn("line", number())
        own = keep(numbered.join(asked, ["doc_id", "line"], "left_semi").select(size.alias("n"), F.explode("prefix").alias("p")), "open-rows")
        # under a word only lines of sizes near those that ask
        keys = own.groupBy(F.shiftright("p", 32).alias("key")).agg(F.ceil(F.min("n") * percent / 100).alias("low"), F.floor(F.max("n") * 100 / percent).alias("high"))
        keys = keep(keys, "open-keys")
        ends = keys.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
        marked = numbered.where(size.between(ends["low"], ends["high"])).join(asked, ["doc_id", "line"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        again = marked.select("doc_id", "place", "bits", "half", "asks", F.explode("prefix").alias("p"))
        again = keep(again.join(small(keys, BROADCAST_ROWS), (F.shiftright("p", 32) == F.col("key")) & size.between(F.col("low"), F.col("high")), "left_semi"), "asked-rows")
        fresh = keep(candidates(again, percent, every=True).drop("more").join(tried, ["a_doc", "a_line", *later], "left_anti"), "near")
        gone = gone.union(verified(fresh, sets_of(fresh), percent).where("alike").select(*later).distinct())
    return repeats.select("doc_id", number().alias("line")).union(gone).distinct()


def own_numbers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(id, hash, row): a number for each id and text, in their order, null ids last. None where every id has one text and none is null, so that ids themselves are such numbers."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.groupBy("id").agg(F.count("*").alias("n")).where("id is null or n > 1").isEmpty():
        return None  # no id twice: texts need not be read
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    each = rows.groupBy("id").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    if each.where("id is null or low <> high").isEmpty():
        return None
    return keep(rows.distinct().orderBy(F.asc_nulls_last("id"), "hash").withColumn("row", F.monotonically_increasing_id()), "row-numbers")


def deduplicated(docs: DataFrame, percent: int = 80, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that repeat or nearly repeat an earlier one taken out, plus a last column, _removed: how many.

    Lines with fewer than ``least`` distinct words always stay, blank ones too. A document that loses
    all lines stays, with an empty text. Null texts and untouched rows come through as they are.
    Rows that share an id are told apart by their texts, and null ids come after all others; rows that repeat both id and text are one
    document, and lose the same lines. An empty table stays
    empty. Columns of any name come through; if one is called _removed, the new one is _removed_.
    """
    numbers = own_numbers(docs, id_col, text_col)
    if numbers is None:
        return _deduplicated(docs, percent, least, id_col, text_col)
    ids, hashed, row = fresh(docs, "id", "hash", "row")
    numbers = numbers.withColumnsRenamed({"id": ids, "hash": hashed, "row": row})
    both = docs.join(numbers, F.col(id_col).cast("long").eqNullSafe(F.col(ids)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(hashed)))
    return _deduplicated(keep(both.drop(ids, hashed), "numbered"), percent, least, row, text_col).drop(row)


def _deduplicated(docs: DataFrame, percent: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """``deduplicated`` where an id is one document."""
    lines = keep(similar_earlier(docs, percent, least, id_col, text_col), "lines-gone")
    doc, own, count = fresh(docs, "doc", "lines", "_removed")
    gone = lines.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line").alias(own))
    gone = F.broadcast(gone) if rows_under(lines, BROADCAST_ROWS) else gone
    both = docs.join(gone, F.col(id_col).cast("long") == F.col(doc), "left")
    numbers = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(own))
    left = let(F.split(F.col(text_col).cast("string"), "\n", -1), lambda x: F.array_join(F.transform(numbers(x), lambda i: F.get(x, i)), "\n"))
    return both.withColumns({text_col: F.when(F.col(doc).isNull(), F.col(text_col)).otherwise(left), count: F.coalesce(F.size(own), F.lit(0)).cast("long")}).drop(doc, own)
