"""Groups of spelling variants: words one edit apart, found by their rarest bigrams.

Of the bigrams of a word, in an order of all bigrams from rare to frequent, one
edit touches at most two. So two words at one edit share one of their three
rarest that the edit leaves alone, at places at most one apart. The edit
is before or after that bigram: the words agree in all up to its end, or in all
from its beginning. That part is the key by which words meet, so a key holds the
bigram and its place, and what is left of the two words must be one edit apart.

Keys of more than ``GROUP`` words (a short part that many words share) are met
by a second key: what is left, whole or without one letter; where what is
left is longer than ``LONG``, its first or its last half. Both lose no pair, so a
key never yields the square of its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batches, keep, small, tidy

#: Shortest words, and how often they must occur. Fixed values.
LETTERS, TIMES = 5, 3
#: One in so many runs loses a letter. Fixed value.
ONE_IN = 97
#: Bigrams of a word that are looked at: one more than an edit can touch.
RAREST = 3
#: A key of more words gets a second key; what is left of a word in letters, up to which its one-letter deletions are that key.
GROUP, LONG = 32, 64
#: Distinct words that a task holds before it hands on their counts; letters of a text looked at in one go; bytes of a run up to which its checksum is made from parts.
HELD, WINDOW, PARTS = 200_000, 4 << 20, 64

#: Latin-1 letters, with A-Z in lower case; all else as a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: One zero byte more, by the last byte of a checksum.
_STEP = np.array([zlib.crc32(bytes([c])) ^ zlib.crc32(b"\0") for c in range(256)], np.uint32)


def _windows(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text, in windows that cut no run."""
    plain = text.encode("latin-1", "replace").translate(_LETTERS)
    if len(plain) <= WINDOW:
        yield plain.split()
        return
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + WINDOW)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


class _Counts(dict):
    """word -> place, with the checksum and length in UTF-8 of each word, and how often it was met."""

    def __init__(self):
        super().__init__()
        self.crc, self.size, self.met = [], [], np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        coded = word if word.isascii() else word.decode("latin-1").encode()
        self.crc.append(zlib.crc32(coded))
        self.size.append(len(coded))
        place = self[word] = len(self)
        return place

    def add(self, places: np.ndarray) -> None:
        more = np.bincount(places, minlength=len(self))
        more[: len(self.met)] += self.met
        self.met = more

    def rows(self, least: int) -> pa.RecordBatch:
        got = [(w.decode("latin-1"), int(self.met[k])) for w, k in self.items() if len(w) >= least and k < len(self.met) and self.met[k]]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], names=["word", "n"])


def _advanced(checksums: np.ndarray, size: int) -> np.ndarray:
    """Checksums of ids, a row for each number of bytes up to ``size`` that follow them; joined by xor with a word's own they are that of both."""
    out = np.empty((size + 1, len(checksums)), np.uint32)
    out[0] = checksums
    for k in range(size):
        out[k + 1] = _STEP[out[k] & 255] ^ (out[k] >> np.uint32(8))
    return out


def _count(counts: _Counts, ids: list, texts: list) -> None:
    """Adds the words of some texts, after the letters that their checksums ask to delete are gone."""
    heads = [f"{'' if i is None else i}:".encode() for i in ids]
    table = _advanced(np.array([zlib.crc32(h) for h in heads], np.uint32), PARTS)

    def add(words: list[bytes], of: np.ndarray) -> None:
        if not words:
            return
        places = np.fromiter(map(counts.__getitem__, words), np.int64, len(words))
        size, crc = np.array(counts.size, np.int64)[places], np.array(counts.crc, np.uint32)[places]
        sums = table[np.minimum(size, PARTS), of] ^ crc
        for k in np.flatnonzero(size > PARTS):
            sums[k] = zlib.crc32(words[k].decode("latin-1").encode(), zlib.crc32(heads[of[k]]))
        hit = sums % ONE_IN == 0
        counts.add(places[~hit])
        cut = []
        for k in np.flatnonzero(hit):
            word, at = words[k], int(sums[k]) % len(words[k])
            cut.append(word[:at] + word[at + 1 :])
        if cut:
            counts.add(np.fromiter(map(counts.__getitem__, cut), np.int64, len(cut)))

    held: list[bytes] = []
    owners: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        for words in _windows(text or ""):
            held += words
            owners.append((k, len(words)))
            if len(held) >= WINDOW // 8:
                add(held, np.repeat([o for o, _ in owners], [n for _, n in owners]))
                held, owners = [], []
    if owners:
        add(held, np.repeat([o for o, _ in owners], [n for _, n in owners]))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """(word, n): the words of all texts, runs of Latin letters with A-Z in lower case, of at least ``letters`` letters and met at least ``times`` times.

    Every 97th run by the checksum of ``<id>:<run>`` loses a letter first; a null id counts as empty text there. Rows that
    repeat count each; null and wordless texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            size = max(1, min(2_000, batch.num_rows * (8 << 20) // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                _count(counts, part.column(0).to_pylist(), part.column(1).to_pylist())
                if len(counts) > HELD:
                    yield counts.rows(letters)
                    counts = _Counts()
        yield counts.rows(letters)

    some = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = some.mapInArrow(tidy(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams from rare to frequent, ties in code-point order. There are at most 90 x 90, so the table is small at any size of the corpus."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("g"))
    counted = grams.groupBy("g").agg(F.count("*").alias("n")).collect()
    return {r["g"]: k for k, r in enumerate(sorted(counted, key=lambda r: (r["n"], r["g"])))}


def keyed(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(part, rest, n): for each of a word's rarest bigrams the word up to its end and what is left (part begins with <), and from its beginning and what is left (>)."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            parts, rests, times = [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                order = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
                for i in sorted(range(len(order)), key=order.__getitem__)[:RAREST]:
                    parts += [f"<{word[: i + 2]}", f">{word[i:]}"]
                    rests += [word[i + 2 :], word[:i]]
                    times += [n, n]
            return {"part": parts, "rest": rests, "n": times}

        return step

    return by_batches(words.select("word", "n"), make, "part string, rest string, n long")


def second_keys(rest: Column) -> Column:
    """What two texts one edit apart have in common one of: up to ``LONG`` letters themselves and all deletions of a letter, from there on their halves, as those of the shorter one are cut."""
    n = F.length(rest)
    none = F.expr("cast(array() as array<string>)")
    without = lambda i: F.concat(F.substring(rest, F.lit(1), i - 1), rest.substr(i + 1, n))
    deleted = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), without)).otherwise(none)

    def halves(least: Column) -> list[Column]:
        first = F.floor(least / 2).cast("int")
        mark = lambda side: F.concat(F.lit(side), least.cast("string"), F.lit(":"))
        return [F.concat(mark("<"), F.substring(rest, F.lit(1), first)), F.concat(mark(">"), rest.substr(n - least + first + 1, n))]

    short = F.when(n <= LONG + 1, F.concat(F.array(rest), deleted)).otherwise(none)
    long = F.when(n > LONG, F.array(*halves(n - 1), *halves(n))).otherwise(none)
    return F.array_distinct(F.concat(short, long))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each two words that one inserted, deleted or replaced letter tells apart, once, with how often they occur."""
    keys = keep(keyed(words, bigram_ranks(words)), "bigram-keys")
    hot = keys.groupBy("part").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select("part", F.lit(True).alias("hot"))
    rows = keys.join(small(hot, 1_000_000), "part", "left").withColumn("second", F.explode(F.when(F.col("hot"), second_keys(F.col("rest"))).otherwise(F.array(F.lit("")))))
    left = rows.select("part", "second", F.col("rest").alias("ra"), F.col("n").alias("na"))
    right = rows.select("part", "second", F.col("rest").alias("rb"), F.col("n").alias("nb"))
    met = left.join(right, ["part", "second"]).where((F.col("ra") < F.col("rb")) & (F.abs(F.length("ra") - F.length("rb")) <= 1))
    met = met.where(F.levenshtein("ra", "rb", 1) == 1)
    own = F.col("part").substr(F.lit(2), F.length("part"))
    word = lambda rest: F.when(F.col("part").startswith("<"), F.concat(own, F.col(rest))).otherwise(F.concat(F.col(rest), own))
    both = met.select(F.array_sort(F.array(*(F.struct(word(f"r{x}").alias("w"), F.col(f"n{x}").alias("n")) for x in "ab"))).alias("p"))
    return both.select(F.col("p")[0]["w"].alias("a"), F.col("p")[0]["n"].alias("na"), F.col("p")[1]["w"].alias("b"), F.col("p")[1]["n"].alias("nb")).distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): form is the near word met most, ties by code points, if it is met at least twice as often."""
    side = lambda w, m, o: F.struct(F.col(w).alias("word"), F.struct((-F.col(m)).alias("n"), F.col(o).alias("w")).alias("o"))
    both = pairs.select(F.explode(F.array(side("a", "nb", "b"), side("b", "na", "a"))).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("o").alias("o"))
    told = F.col("o").isNotNull() & (-F.col("o.n") >= 2 * F.col("n"))
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(told, F.col("o.w")).alias("form"), F.when(told, -F.col("o.n")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling: every round the root of a word becomes its root's root. Counts at least double along a path, so there are few rounds."""
    own = found.where("form is not null")
    now = own.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        now = keep(moved, "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Words, their letters and counts are those of ``word_counts``. Two words are near if one
    inserted, deleted or replaced letter tells them apart. ``root`` is where forms lead, the word
    itself if it has none. Empty tables and texts without words give no rows; other columns of ``docs``
    are not read.
    """
    words = keep(word_counts(docs, id_col, text_col), "words")
    found = keep(forms(words, near_pairs(words)), "forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
