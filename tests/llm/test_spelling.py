import random
import re
import zlib
from collections import Counter

import pytest

from quillframe.llm import queries, spelling


def words_by_hand(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(words):
    out = {}
    for w, n in words.items():
        close = sorted((-words[o], o) for o in words if near(w, o))
        form = close[0][1] if close and -close[0][0] >= 2 * n else None
        out[w] = (n, len(close), form, words[form] if form else None)
    rows = set()
    for w, (n, k, form, m) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, form, root, n, k, m))
    return rows


def edited(r, word, letters):
    at, kind = r.randrange(len(word)), r.randrange(3)
    return word[:at] + (r.choice(letters) if kind else "") + word[at + (kind != 2) :]


def corpus(seed, letters="abcdefgh\u00c9\u00e9\u00d7", n=60):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.choice([4, 5, 6, 7, 9, 14, 66]))) for _ in range(40)]
    base += [edited(r, w, letters) for w in base for _ in range(6)]
    base += [edited(r, w, letters) for w in base[-100:]] + ["ZEBRA" + x for x in letters] + [f"prefix{a}{b}" for a in letters for b in letters]
    pick = lambda: r.choice(base[: r.choice([20, 200, len(base)])])
    return [(i, r.choice([" ", "-", "7", "\u2019", "\u0100"]).join(pick() for _ in range(r.randrange(200)))) for i in range(n)]


def found(spark, docs):
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len({r["word"] for r in got})
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


@pytest.mark.parametrize("group, long", [(32, 64), (3, 64), (3, 4), (0, 5)])
def test_against_brute_force(spark, monkeypatch, group, long):
    """Also where nearly every key gets second keys, of both kinds."""
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "LONG", long)
    docs = corpus(group + long)
    truth = by_hand(words_by_hand(docs))
    assert found(spark, docs) == truth and sum(t[1] is not None for t in truth) > 20


def test_roots_of_long_paths(spark):
    """Each word has half the count of the next, which is one letter longer."""
    path = ["b" * k for k in range(5, 14)]
    rows = spark.createDataFrame([(w, 3 << k) for k, w in enumerate(path)], "word string, n long")
    got = spelling.roots(spelling.forms(rows, spelling.near_pairs(rows))).collect()
    assert {(r["word"], r["root"]) for r in got} == {(w, path[-1]) for w in path[:-1]}


def test_words_of_windows_and_long_runs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WINDOW", 64)
    monkeypatch.setattr(spelling, "HELD", 10)
    docs = [*corpus(5), (77, ("long" * 40 + " ") * 300), (None, "nameless " * 500), (78, None), (79, "")]
    docs += [(i, "x" * i + " checksum" * 3) for i in range(60, 70)]
    got = {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == words_by_hand(docs) and any(len(w) == 160 for w in got)


def test_a_hot_key_makes_no_squares(spark):
    """Thousands of words that share their rarest bigrams, as they have few letters, and of which few are near."""
    r = random.Random(1)
    words = sorted({"z" + "".join(r.choice("abc") for _ in range(r.choice([9, 10, 11]))) for _ in range(3000)})
    rows = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    keys = spelling.keyed(rows, spelling.bigram_ranks(rows))
    assert keys.groupBy("part").count().agg({"count": "max"}).first()[0] > 500
    pairs = {(x["a"], x["b"]) for x in spelling.near_pairs(rows).collect()}
    close = lambda w: {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in ("", *"zabc")} - {w}
    assert pairs == {(a, b) for a in words for b in close(a) & set(words) if a < b}


def test_odd_tables(spark, odd_docs, no_docs):
    truth = by_hand(words_by_hand([(r["doc_id"], r["text"]) for r in odd_docs.collect()]))
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(odd_docs).collect()}
    assert got == truth and spelling.variants(no_docs).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    got = {(r["word"], r["n"]) for r in queries.op13_spelling_variants(spark, sf).collect()}
    assert got == set(words_by_hand(docs).items())
