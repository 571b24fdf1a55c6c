import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillframe.llm import ngram_join as nj
from quillframe.llm.common import WordHash, components


def by_hand(rows, k, percent):
    words, sets = WordHash(), {}
    for i, t in rows:
        sets[i] = set(nj.shingles(t, k, words).tolist())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter()
        for g in sets[i]:
            shared.update(where[g])
            where[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed=3):
    """Groups of near copies of several sizes, a chain, and loners."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size, group in ((60, 25), (400, 40), (30, 5), (12, 8), (900, 6)):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(group):
            own = list(base)
            for _ in range(r.randint(0, max(1, size // 60))):
                own[r.randrange(size)] = r.choice(words)
            texts.append(" ".join(own))
    chain = [r.choice(words) for _ in range(300)]
    for _ in range(12):
        chain = chain[4:] + [r.choice(words) for _ in range(4)]
        texts.append(" ".join(chain))
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(60)]
    texts += texts[:20] + [t.upper() for t in texts[:5]]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rows = corpus()
    got = nj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_hand(rows, k, percent)


def test_small_trees_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nj, "TREE", 7)
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 3)
    rows = corpus(9)
    got = nj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_hand(rows, 3, 90)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 10**9), min_size=1, max_size=120), st.integers(0, 2**32), st.sampled_from([80, 90]))
def test_similar_sets_share_a_key(base, seed, percent):
    r, ends = random.Random(seed), nj.size_bands(percent)
    a = np.array(sorted(base), np.uint64)
    keep = [x for x in base if r.random() > 0.05]
    b = np.array(sorted({*keep, *(r.randrange(10**9) for _ in range(r.randint(0, 3)))}), np.uint64)
    shared = len(np.intersect1d(a, b))
    if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
        assert np.intersect1d(nj.block_keys(a, percent, ends), nj.block_keys(b, percent, ends)).size


def test_tree_finds_all(spark):
    r = np.random.default_rng(1)
    counts = r.poisson(3, (500, nj.VECTOR)).astype(np.uint16)
    counts[1::2] = np.maximum(0, counts[::2].astype(int) + r.integers(-1, 2, (250, nj.VECTOR)) * (r.random((250, nj.VECTOR)) < 0.05))
    n = counts.sum(axis=1).astype(np.int64)
    tree = nj.RTree(n, counts, np.arange(500), 90)
    for i in range(0, 500, 37):
        q = counts[i].astype(np.int64)
        bound = np.minimum(counts, q).sum(axis=1)
        ok = (190 * bound >= 90 * (n + n[i])) & (90 * n <= 100 * n[i]) & (100 * n >= 90 * n[i]) & (np.arange(500) != i)
        assert sorted(tree.search(int(n[i]), q, i)) == sorted(np.flatnonzero(ok))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (50, 50)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["comp"] for r in got} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_odd_rows(odd_docs, no_docs):
    got = nj.jaccard_join(odd_docs, 3, 90).collect()
    assert len(got) == 12
    assert sorted((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in got if r["doc_id"]) == [
        (1, True, 1), (1, True, 1), (2, True, 1), (3, False, 3), (4, False, 4), (5, False, 5), (6, True, 6), (7, True, 7), (8, True, 8), (9, True, 9),
    ]
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert nj.jaccard_join(no_docs, 3, 90).count() == 0
    kept = nj.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_blocks_bound_rows_and_miss_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nj, "TREE", 50)
    rows = [(7, 700, i, 0 if i < 400 else i, 0) for i in range(700)] + [(8, 40, i, i % 2, 0) for i in range(40)]
    trees = defaultdict(list)
    for r in nj.blocks(spark.createDataFrame(rows, "key long, size long, node long, comp long, main long")).collect():
        trees[r["tree"]].append(r)
    pairs = Counter()
    for t in trees.values():
        assert len(t) <= 4 * 50 and len({r["node"] for r in t}) == len(t)
        pairs.update({(min(x, y), max(x, y)) for x in (r["node"] for r in t if r["asks"]) for y in (r["node"] for r in t if r["indexed"]) if x != y})
    assert all((i, j) in pairs for i in range(700) for j in range(max(i + 1, 400), 700))


def test_one_of_each_group_stays(spark):
    r = random.Random(4)
    a, b, c, d = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(60)) for x in "abcd")
    near = c + " more"
    rows = [
        (1, a), (2, a), (2, b),  # a copy of 1 under the id of a clean text
        (3, c), (3, near),  # near copies under one id
        (None, a), (None, near), (None, d), (None, d), (None, None), (None, " "), (None, " "),
        (7, a + " x"), (8, b + " y"),
    ]
    kept = [tuple(x) for x in nj.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((x for x in kept if x[0] != 3), key=str) == sorted([(1, a), (2, b), (None, d), (None, None), (None, " "), (None, " ")], key=str)
    assert [x for x in kept if x[0] == 3] in ([(3, c)], [(3, near)])


def test_repeated_rows_and_clashing_names(spark):
    text = "a text of some words that says the same again and again "
    names = "doc_id long, text string, number long, hash string, _gone long, _text string, row string, comp long, lead string"
    rows = [(i, text * 3, 7, "h", 8, "t", "r", 9, "l") for i in (2, 2, 2, 5, None)] + [(4, "other words", 7, "h", 8, "t", "r", 9, "l")] * 2
    kept = nj.keep_one(spark.createDataFrame(rows, names))
    assert kept.columns == [x.split()[0] for x in names.split(", ")]
    assert sorted(tuple(x) for x in kept.collect()) == sorted([rows[0], rows[-1]])


def test_key_with_one_repeated_row(spark):
    """Rows that repeat make keys look shared; a key with one node alone finds nothing."""
    rows = [(1, "one two three four")] * 5 + [(2, "five six seven eight")]
    got = nj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1)] * 5 + [(2, 2, 2)]


def test_keys_are_dealt_once(spark, monkeypatch):
    """Keys are the most of what the join writes: one shuffle of them, not one to count and one to join."""
    r = random.Random(5)
    rows = [(r.choice([-1, 1]) * r.randrange(1, 1500), r.randrange(6)) for _ in range(4000)]
    rows += [(7, n) for n in range(900)] + [(8, 3)] * 900 + [(9, 1)] * 30
    nodes = defaultdict(set)
    for key, node in rows:
        nodes[key].add(node)
    wanted = sorted((k, n) for k, own in nodes.items() if len(own) > 1 for n in own)
    dealt = spark.createDataFrame(rows, "key long, node long").repartition(3)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        for size in (1, 3, 10_000):
            spark.conf.set(batch, size)
            assert sorted(map(tuple, nj.open_rows(dealt).collect())) == wanted
    finally:
        spark.conf.set(batch, before)
    monkeypatch.setattr(nj, "HOT", 500)
    monkeypatch.setattr(nj, "GLANCE", 1)
    hot = sorted(map(tuple, nj.open_rows(dealt).collect()))
    # of a key with very many rows the rows pass, whoever's they are
    assert hot == sorted([*wanted, (8, 3)])
    assert nj.open_rows(dealt.limit(0)).isEmpty()


def test_parities_bound_the_difference():
    r = np.random.default_rng(4)
    for _ in range(300):
        n, m, shared = (int(x) for x in r.integers(1, 3000, 3))
        h = r.integers(0, 2**63, n + m + shared).astype(np.uint64)
        a, b = h[: n + shared], h[n:]
        assert nj.parities_differ(nj.parity(a), nj.parity(b)) <= n + m
    assert nj.parities_differ(nj.parity(h), nj.parity(h)) == 0


def test_a_passage_in_common_sends_no_grams(spark, monkeypatch):
    """Long texts that share a passage alone meet under its keys and pass the bound of the count vectors; their n-grams are not read."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    passage = some(300)
    texts = [" ".join(some(2000) + passage + some(2000)) for _ in range(30)]
    near = texts[3].split()
    near[100] = "other"
    rows = [*enumerate(texts), (50, " ".join(near))]
    seen, verified = [], nj.verified
    monkeypatch.setattr(nj, "verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    out = nj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: 3 if i == 50 else i for i, _ in rows}
    assert sum(seen) == 1
