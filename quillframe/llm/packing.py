"""Best-fit decreasing packing of tokenised documents into sequences of fixed size.

Documents become token ids, ended by an id of 0; those longer than a sequence
are cut. Only lengths decide where a piece goes, and pieces of equal length are
alike, so best-fit decreasing runs once for the whole corpus on how many pieces
there are of each length: a segment tree over remaining capacities finds the
tightest open sequences in logarithmic time, and runs of sequences with equal
remaining capacity are filled together. This plan has a few rows a length, whatever
the corpus. Each piece then finds its sequence and offset by its number among the
pieces of its length, which tasks count for themselves and sums make global.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import by_batches, fresh, keep, share, small, tidy

#: Rows up to which the counts of pieces by task and length are broadcast.
BROADCAST_ROWS = 1_000_000
DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def byte_bpe(path: str) -> tuple[tiktoken.Encoding, tuple[str, ...]]:
    """A byte-level BPE file of the tokenizers library, read into tiktoken's faster form of the same merges.

    In such files ids follow the order of merges, so an id is its token's rank.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


class Encoder:
    """Ids of a text by a tokenizer file. Where tiktoken gives up (its pattern looks back over white space, and a run of a million characters is too long for that), the file's own library, which is slower, reads the text."""

    def __init__(self, path: str):
        self.path, self.plain = path, None
        self.fast, self.special = byte_bpe(path)

    def __call__(self, text: str) -> list[int]:
        try:
            if any(s in text for s in self.special):
                return self.fast.encode(text, allowed_special="all")
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # with special tokens a ValueError, else a panic of native code, which is no Exception
            if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                raise
        self.plain = self.plain or Tokenizer.from_file(self.path)
        return self.plain.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every row's tokens and its closing 0.

    A row of at most ``capacity`` ids is one piece. Longer ones are cut into
    pieces of ``capacity``, of which the first takes what is left over. A null
    or empty text is the single id 0. Rows that repeat, and null ids, give pieces of their own; an empty table gives
    none. Texts may be of any length and hold runs of any one character. Further columns, of any name, are not read.
    """

    def make():
        encode = Encoder(tokenizer)

        def step(batch):
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), 0], "<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        parts.append(ids[a:b].tolist())
            return {"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc, "ids": parts}

        return step

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return by_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, schema)


class OpenSequences:
    """Open sequences by remaining capacity, under a segment tree that tells which capacities occur. Runs of numbers share one."""

    def __init__(self, capacity: int):
        self.capacity, self.width = capacity, 1 << capacity.bit_length()
        self.some = bytearray(2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def _mark(self, room: int, value: int) -> None:
        i = room + self.width
        self.some[i] = value
        while i > 1:
            i >>= 1
            value = self.some[2 * i] | self.some[2 * i + 1]
            if self.some[i] == value:
                return
            self.some[i] = value

    def tightest(self, length: int) -> int:
        """The smallest remaining capacity of at least ``length`` that occurs, or -1."""
        i = length + self.width
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < self.width:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.width

    def _open(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            if len(self.runs[room]) == 1:
                self._mark(room, 1)

    def fill(self, length: int, count: int) -> list[tuple[int, int, int, int]]:
        """Places ``count`` pieces one after the other: (how many, first sequence, how many a sequence, offset of the first in each).

        The tightest sequence takes pieces until none fits any more, as each makes it tighter still; then comes the next.
        """
        out = []
        while count:
            room = self.tightest(length)
            if room < 0:
                room, each = self.capacity, self.capacity // length
                first, held = self.count, -(-count // each)
                self.count += held
            else:
                each = room // length
                first, held = self.runs[room].pop()
                if not self.runs[room]:
                    self._mark(room, 0)
            whole = min(held, count // each)
            rest = count - whole * each if whole < held else 0
            out.append((whole * each + rest, first, each, self.capacity - room))
            self._open(room - each * length, first, whole)
            if whole < held:
                self._open(room - rest * length, first + whole, 1)
                self._open(room, first + whole + 1, held - whole - 1)
            count -= whole * each + rest
        return out

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of one piece."""
        ((_, sequence, _, offset),) = self.fill(length, 1)
        return sequence, offset


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Best-fit decreasing of ``counts`` pieces by length: by length, rows (number of the first piece, first sequence, pieces a sequence, offset)."""
    at, out = OpenSequences(capacity), {}
    for length in sorted(counts, reverse=True):
        filled = np.array(at.fill(length, counts[length]), np.int64)
        out[length] = np.column_stack([np.cumsum(filled[:, 0]) - filled[:, 0], filled[:, 1:]])
    return out


def _numbered(cut: DataFrame, task: str, number: str) -> DataFrame:
    """Adds the task, and the number of each piece among those of its length in the task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + f", {task} int, {number} long"

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(1, np.int64)
        for batch in batches:
            n = batch.column("length").to_numpy()
            if not len(n):
                continue
            if (top := int(n.max())) >= len(seen):
                seen = np.r_[seen, np.zeros(top + 1 - len(seen), np.int64)]
            order = np.argsort(n, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(n[order]) != 0])
            own = np.empty(len(n), np.int64)
            own[order] = np.arange(len(n)) - np.repeat(start, np.diff(np.r_[start, len(n)]))
            own += seen[n]
            seen += np.bincount(n, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(own)], names=[*batch.schema.names, task, number])

    return cut.mapInArrow(tidy(run), schema)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``; offsets in a sequence follow each other without a gap.

    Only lengths decide, so equal lengths may change places; rows that repeat and null ids are pieces like others. An
    empty table stays empty.
    """
    task, number, before = fresh(cut, "task", "number", "before")
    numbered = keep(_numbered(cut, task, number), "pieces")
    counts = keep(numbered.groupBy(task, "length").agg(F.count("*").alias("n")), "lengths")
    upto = Window.partitionBy("length").orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(task, "length", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("long").alias(before))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = share(cut.sparkSession, plan(totals, capacity))
    ranked = numbered.join(small(keep(offsets, "offsets"), BROADCAST_ROWS), [task, "length"])
    ranked = ranked.select(*cut.columns, (F.col(before) + F.col(number)).alias(number))
    names = cut.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def run(batches):
        own = places()
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column(number).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n):
                at = np.flatnonzero(n == length)
                rows = own[int(length)]
                first, base, each, start = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1].T
                inner, place = np.divmod(rank[at] - first, each)
                sequence[at], offset[at] = base + inner, start + place * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(run), f"{kinds}, sequence_id long, offset long")


def sequences(cut: DataFrame, packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces ``with_ids`` and their packing; at most one sequence's ids meet in a group."""
    both = cut.join(packed.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset"), ["doc_id", "piece", "ids_crc32"])
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
