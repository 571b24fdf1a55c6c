import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillframe.llm import packing


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == capacity or k == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(bins)


def plain_best_fit(lengths, capacity):
    """How many sequences best-fit decreasing takes, one piece after the other over sorted remaining capacities."""
    rooms, count = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            count, room = count + 1, capacity
        else:
            room = rooms.pop(at)
        if room > n:
            bisect.insort(rooms, room - n)
    return count


@pytest.mark.parametrize("capacity", [2048, 64])
def test_documents(spark, capacity):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a <|endoftext|> b é😀  it's   "), (10**6 + 3, "word " * 9000)], "doc_id long, text string")
    docs = docs.union(extra).repartition(7)
    rows = packing.pack(packing.pieces(docs, capacity), capacity).collect()
    n = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, capacity)
    assert n == plain_best_fit([r["length"] for r in rows], capacity)


ODD = [
    "a" + " " * 1_000_000 + "b", "\t" * 1_200_000, "x" + "\n \t\u3000" * 300_000, " " * 1_000_000 + "<|endoftext|>" + " " * 1_500_000 + "end", "q" * 1_000_000, "7" * 500_000, "-" * 500_000, "é" * 400_000, "\U0001f600" * 200_000, "'" * 500_000, "\u0301" * 300_000,
]


def test_long_runs(spark):
    """Runs of white space that tiktoken cannot read, and of other characters that it can."""
    texts = dict(enumerate(ODD))
    rows = packing.pack(packing.pieces(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4))).collect()
    check(rows, texts, 2048)


def test_ten_million_spaces(spark):
    table = spark.sql("select 1L as doc_id, concat('a', repeat(' ', 10000000), 'b') as text union all select 2L, 'short'")
    rows = packing.pack(packing.pieces(table)).collect()
    check(rows, {r["doc_id"]: r["text"] for r in table.collect()}, 2048)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70), st.lists(st.tuples(st.integers(1, 70), st.integers(1, 40)), max_size=30))
def test_plan_is_best_fit_decreasing(capacity, pieces):
    counts = {}
    for length, n in pieces:
        if length <= capacity:
            counts[length] = counts.get(length, 0) + n
    held = defaultdict(list)
    for length, rows in packing.plan(counts, capacity).items():
        for k in range(counts[length]):
            first, sequence, each, offset = rows[np.searchsorted(rows[:, 0], k, "right") - 1]
            inner, place = divmod(k - first, each)
            held[sequence + inner].append((offset + place * length, length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == plain_best_fit([k for k, n in counts.items() for _ in range(n)], capacity)


def test_plan_of_a_large_corpus():
    """The plan's size follows the lengths, not the pieces."""
    counts = {k: 10**9 + 7919 * k for k in range(1, 2049)}
    rows = packing.plan(counts, 2048)
    assert sum(map(len, rows.values())) < 20_000


def test_tightest_is_best_fit():
    r = random.Random(7)
    for _ in range(40):
        capacity = r.choice([7, 50, 300])
        at, rooms = packing.OpenSequences(capacity), []
        for _ in range(200):
            length = r.randint(1, capacity)
            fits = [x for x in rooms if x >= length]
            best = min(fits) if fits else capacity
            sequence, offset = at.place(length)
            assert capacity - offset == best
            if fits:
                rooms.remove(best)
            if best > length:
                rooms.append(best - length)
        assert at.count >= len(rooms)


def test_sequences(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 40)) for i in range(60)], "doc_id long, text string")
    cut = packing.pieces(docs, 128, with_ids=True)
    packed = packing.pack(cut.drop("ids"), 128)
    got = packing.sequences(cut, packed).collect()
    assert sum(len(r["ids"]) for r in got) == packed.agg({"length": "sum"}).first()[0] and max(len(r["ids"]) for r in got) <= 128


def test_odd_rows(odd_docs, no_docs):
    assert packing.pack(packing.pieces(odd_docs)).where("piece = 0").count() == 12
    assert packing.pack(packing.pieces(no_docs)).count() == 0
