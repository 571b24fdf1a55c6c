import random

import numpy as np
import pytest

from quillframe.llm import linededup as ld


def by_hand(docs, percent, least):
    lines = [(i, k, frozenset(t.encode().lower().split())) for i, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]) for k, t in enumerate(text.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    gone = set()
    for n, (i, k, own) in enumerate(lines):
        if any(100 * len(own & other) >= percent * len(own | other) for _, _, other in lines[:n]):
            gone.add((i, k))
    return gone


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = ["the", "of", "and"] * 8 + [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 6, 9, 12, 25, 60, 150]))] for _ in range(30)]

    def line():
        own = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            own[r.randrange(len(own))] = r.choice(vocab)
        r.shuffle(own) if r.random() < 0.1 else None
        return " ".join(own).upper() if r.random() < 0.1 else " ".join(own)

    return [(i, "\n".join(r.choice(["", "De.", " ", line(), line(), line()]) for _ in range(r.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("group", [2048, 6])
@pytest.mark.parametrize("percent", [80, 60])
def test_against_brute_force(spark, monkeypatch, percent, group):
    """With small groups, words are dealt in parts of a few lines."""
    if group == 6:
        monkeypatch.setattr(ld, "GROUP", 6)
        monkeypatch.setattr(ld, "GLANCE", 1)
        monkeypatch.setattr(ld, "PART", (3, 5))
    docs = corpus(percent + (17 if group == 2048 else 3))
    got = ld.similar_earlier(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()
    assert {tuple(x) for x in got} == by_hand(docs, percent, ld.LEAST_WORDS) and len(got) == len({tuple(x) for x in got})


def test_repeated_and_null_ids(spark):
    """Rows that share an id are documents of their own, ordered by their texts' hashes; null ids come last."""
    r = random.Random(11)
    texts = [t for _, t in corpus(21, 90)]
    rows = [(r.choice([None, 5, 5, 6, i]), t) for i, t in enumerate(texts)] + [(5, texts[3]), (None, texts[4]), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {t: h for t, h in table.selectExpr("text", "xxhash64(text)").collect()}
    order = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, hashed[x[1]]))
    gone = by_hand([(n, t) for n, (_, t) in enumerate(order)], 80, ld.LEAST_WORDS)
    cut = {(i, t): None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (n, k) not in gone) for n, (i, t) in enumerate(order)}
    got = ld.deduplicated(table.repartition(3)).collect()
    told = lambda rows: sorted(rows, key=repr)
    assert told((x["doc_id"], x["text"]) for x in got) == told((i, cut[i, t]) for i, t in rows)
    assert any(x["_removed"] for x in got if x["doc_id"] is None)


def test_a_line_is_not_taken_for_that_of_another_row(spark):
    rows = [(1, "a line that others repeat"), (5, "a line that others repeat\nmore here"), (5, "a wholly unique first line nobody repeats\nlast of all")]
    got = {(r["text"], r["_removed"]) for r in ld.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(rows[0][1], 0), ("more here", 1), (rows[2][1], 0)}


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_ROWS", 1)
    docs = corpus(8)
    assert {tuple(x) for x in ld.similar_earlier(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == by_hand(docs, 80, ld.LEAST_WORDS)


def test_text_that_is_left(spark):
    rows = [(2, "one two three four five\nshort\n\nother words stand in this line"), (1, "ONE two three four five\nkept 😀"), (3, "one two three four five")]
    got = {r["doc_id"]: (r["text"], r["_removed"]) for r in ld.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("ONE two three four five\nkept 😀", 0), 2: ("short\n\nother words stand in this line", 1), 3: ("", 1)}


def test_short_lines(spark):
    rows = [(1, "Home\nHome | About\na b c d\nx y z"), (2, "home\nabout | HOME\na b c d e\nx y w\n\n \n"), (3, None)]
    got = {r["doc_id"]: (r["text"], r["_removed"]) for r in ld.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("x y w\n\n \n", 3), 3: (None, 0)}
    longer = ld.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), least=5).collect()
    assert all(r["_removed"] == 0 for r in longer)


def test_clashing_names(spark):
    names = "doc_id long, text string, doc string, lines string, _removed string, _doc string, _lines string, key long, more long, line long, place long"
    row = ("same words in a line", "a", "b", "c", "d", "e", 1, 2, 3, 4)
    got = ld.deduplicated(spark.createDataFrame([(1, *row), (2, *row)], names))
    assert got.columns[-1] == "_removed_" and sorted(tuple(r)[1:5] for r in got.collect()) == [("", "a", "b", "c"), (*row[:4],)]


def test_places_rule_out_a_template(spark, monkeypatch):
    """Lines that differ in a number are under one word, and no two of them meet."""
    monkeypatch.setattr(ld, "GROUP", 100)
    rows = spark.createDataFrame([(i, 6, 0, 0, 7 << 32 | 1) for i in range(5000)], "doc_id long, place long, bits long, half long, p long")
    assert ld.in_parts(rows, spark.createDataFrame([(7,)], "key long"), 80).count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = ld.deduplicated(odd_docs)
    assert got.columns == [*odd_docs.columns, "_removed"] and got.count() == 12
    left = {r["doc_id"]: r for r in got.collect() if r["doc_id"] not in (None, 1)}
    assert left[2]["text"] == "" and left[9]["_removed"] == 49 and left[3]["text"] is None
    assert ld.deduplicated(no_docs).count() == 0


@pytest.mark.parametrize("percent", [80, 60])
def test_pairs_of_a_key(monkeypatch, percent):
    monkeypatch.setattr(ld, "CHUNK", 50)
    r = random.Random(percent)
    rows = sorted((r.randrange(6), n := r.randint(1, 30), r.randrange(ld.prefix_size(n, percent))) for _ in range(400))
    key, n, at = (np.array(x, np.int64) for x in zip(*rows))
    got = [(int(a), int(b)) for i, j in ld._close(key, n, at, percent) for a, b in zip(i, j)]
    expected = {
        (i, j) for i in range(400) for j in range(i + 1, 400)
        if key[i] == key[j] and 100 * n[i] >= percent * n[j] and (100 + percent) * min(n[i] - at[i], n[j] - at[j]) >= percent * (n[i] + n[j])
    }
    assert len(got) == len(set(got)) and set(got) == expected


def test_pairs_that_places_rule_out_are_never_made():
    size = 50_000  # lines of six words, the word that they share second: no two are similar
    key, n, at = np.full(size, 7), np.full(size, 6), np.ones(size, np.int64)
    assert sum(len(i) for i, _ in ld._close(key, n, at, 80)) == 0
    assert not list(ld._close(key[:0], n[:0], at[:0], 80))


def test_repeats_within_a_text_are_told_in_its_task(spark):
    """What a text repeats of itself is marked where its lines are read, so that only lines that several texts have are joined."""
    docs = [(1, "a b c\nx y\nC b a a\n\na b c"), (2, "a b c\nz"), (3, "x\nx\ny\nx"), (4, None), (5, "\n\n")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    counts = spark.sparkContext.broadcast(ld.word_counts(rows, 64))
    got = {(r.doc_id, r.place >> 32) for r in ld.line_sets(rows, counts, 80, 1).collect() if r.again}
    assert got == {(1, 2), (1, 4), (3, 1), (3, 3)}
    assert {tuple(r) for r in ld.similar_earlier(rows).collect()} == got | {(2, 0)}


def test_words_of_texts_and_lines():
    """Text and line numbers of words, which counting words alone does without."""
    r = random.Random(2)
    parts = ["a", "B", "é", " ", "\n", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", " " * 70, "x" * 64, "y" * 65, "word"]
    for _ in range(300):
        texts = [None if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 5))]
        text, line, h = ld.hashed_words(texts)
        plain = [(i, j, w) for i, t in enumerate(texts) for j, x in enumerate((t or "").encode().lower().split(b"\n")) for w in x.split()]
        assert list(zip(text.tolist(), line.tolist())) == [x[:2] for x in plain]
        assert len({(x, w) for x, (_, _, w) in zip(h.tolist(), plain)}) == len(set(h.tolist())) == len({w for _, _, w in plain})
        assert (ld._words(texts)[-1] == h).all()


def test_ids_that_never_repeat_are_told_without_texts(spark):
    """Where no id is twice, telling rows apart reads ids alone."""
    ids = spark.createDataFrame([(3,), (1,), (2,)], "doc_id long")
    unread = ids.selectExpr("doc_id", "cast(raise_error('a text was read') as string) as text")
    assert ld.own_numbers(unread, "doc_id", "text") is None
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    assert ld.own_numbers(same, "doc_id", "text") is None
    for rows in ([(1, "a"), (1, "b")], [(None, "a"), (1, "a")]):
        numbers = ld.own_numbers(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
        assert numbers.count() == 2


def test_hashes_tell_words_apart_at_every_byte():
    """Words of all lengths about a multiple of eight bytes, wherever they begin, that differ in one byte, in a byte more, or in zero bytes behind."""
    words = {"a\0", "a\0\0", "a", *("x" * n for n in range(1, 80)), *("x" * n + "\0" for n in range(1, 80))}
    words |= {"x" * k + "y" + "x" * (n - k - 1) for n in (7, 8, 9, 16, 17, 63, 64, 65) for k in range(n)}
    words = sorted(words)
    seen = [ld._words([" " * shift + " ".join(words)])[-1].tolist() for shift in range(9)]
    assert len(set(seen[0])) == len(words) and all(x == seen[0] for x in seen)


def test_verified_pairs(spark):
    """Shares of words of sets of very different sizes, at the threshold and just below it."""
    sets = {1: range(10), 2: range(1, 11), 3: range(8), 4: range(900), 5: range(90, 990), 6: range(100, 1000), 7: range(7), 8: [2**64 - 1, 5], 9: [5]}
    rows = [(i, 0, bytearray(np.array(sorted(x), np.uint64).tobytes())) for i, x in sets.items()]
    table = spark.createDataFrame(rows, "doc_id long, line int, words binary")
    pairs = [(a, 0, b, 0) for a in sets for b in sets if a < b]
    got = ld.verified(spark.createDataFrame(pairs, "a_doc long, a_line int, b_doc long, b_line int"), table, 80).collect()
    alike = lambda x, y: 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})
    assert {(r.a_doc, r.b_doc): r.alike for r in got} == {(a, b): alike(sets[a], sets[b]) for a, _, b, _ in pairs}


def test_pairs_tried_of_a_group_of_variants(spark):
    """Of lines that share many rare words, each is first tried against a few over all its words, and told to have more."""
    r = random.Random(5)
    docs = [(i, " ".join(r.sample([f"w{k}" for k in range(60)], 56))) for i in range(120)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    counts = spark.sparkContext.broadcast(ld.word_counts(rows, ld.SLOTS))
    lines = ld.dealt(ld.line_sets(rows, counts, 80, 1))
    pairs = ld.candidates(lines, 80, every=False).collect()
    tried = {}
    for p in pairs:
        assert p.a_doc < p.b_doc
        tried.setdefault(p.b_doc, []).append(p.more)
    assert len(pairs) == len({p[:4] for p in pairs}) and max(map(len, tried.values())) == ld.TRIED
    every = ld.candidates(lines.withColumn("asks", ld.F.lit(True)), 80, every=True)
    passing = {b: {x.a_doc for x in every.where(f"b_doc = {b}").collect()} for b in (3, 60, 119)}
    for b, all_of_them in passing.items():
        own = {p.a_doc for p in pairs if p.b_doc == b}
        assert own <= all_of_them and (own == all_of_them or all(tried[b]))
    assert {tuple(x) for x in ld.similar_earlier(rows).collect()} == by_hand(docs, 80, 1)
