"""N-gram Jaccard join over a count-vector R-tree.

A document is the set of its distinct word n-grams. Documents with equal sets
form a class, and one node stands for the class. Each n-gram falls into one of
``VECTOR`` groups, and the counts a group make a node a point. Since
``|A & B| <= sum_g min(a_g, b_g)``, an R-tree over such points bounds the overlap
of a query with a whole subtree by summing minima against the subtree's upper
corner. Of pairs that pass the bound, parities of about a bit an n-gram (how many
hashes fall on a bit, odd or even) bound the difference from below; only pairs that
pass this too are verified on the n-grams themselves.

One R-tree over a corpus fits no machine, so the points are dealt to many small
trees first, without losing a pair. Linked sets of sizes within one size band
differ in at most ``D`` n-grams. Cut into more than ``D`` blocks by hash, they
agree wholly on one block at least; the content of a block is the key of a
tree. Trees with the same members are searched once. In the first search each
point asks for its most promising partner only; what links grows components.
The second search asks for every pair that passes the bound between points of
different components, skipping subtrees of the query's own component. So a
group of thousands of copies costs a row or so a member and key, and no link
between different texts is lost.

Sets are of 64-bit n-gram hashes, and a class is told by a 64-bit sum of them.
Chance equality is beyond practical reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, components, forget, fresh, groups_of, keep, list_array, mix, release, rows_under, small, tidy, WordHash

#: Groups of the count vectors.
VECTOR = 128
#: Members of a tree beyond which it is dealt out in parts.
TREE = 4096
#: Rows up to which a table of ids is broadcast.
BROADCAST_ROWS = 1_000_000
LEAF = 16
#: Rows under a key from which they are not dealt by it; a key is known by one row of every ``GLANCE``.
HOT, GLANCE = 65_536, 16


def shingles(text: str | None, k: int, words: WordHash) -> np.ndarray:
    """Sorted distinct hashes of a text's word k-grams; of the whole sequence where it has fewer words."""
    w = words.many(text.encode().lower().split()) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    width = min(k, len(w))
    out = np.full(len(w) - width + 1, width, np.uint64)
    for j in range(width):
        out = mix(out + w[j : j + len(out)])
    return np.unique(out)


def size_bands(percent: int, top: int = 1 << 40) -> list[int]:
    """Lower ends of the size bands; each is 1.6 times the one before, so partners lie at most one band apart."""
    ends = [1]
    while ends[-1] < top:
        ends.append(max(ends[-1] + 1, ends[-1] * 8 // 5))
    return ends


def spare_blocks(low: int, blocks: int) -> int:
    """Blocks added so that hardly any document of a band has more empty blocks than this."""
    spare = 0
    for _ in range(4):
        empty = (blocks + spare) * np.exp(-low / (blocks + spare))
        spare = int(np.ceil(empty + 3 * np.sqrt(empty))) if empty > 0.01 else 0
    return spare


def block_keys(h: np.ndarray, percent: int, ends: list[int]) -> np.ndarray:
    """Keys of the blocks of a set, in its own size band and, if a partner may lie there, in the next.

    With ``spare`` blocks more than differences, more than ``spare`` blocks agree. A set with at
    most ``spare`` empty blocks therefore needs no key for those; others emit them too.
    """
    n, out = len(h), []
    if not n:
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(ends, n, "right")) - 1
    for band in (own, own + 1):
        low, high = ends[band], ends[band + 1] - 1
        most = 2 * high * (100 - percent) // (100 + percent)
        if 100 * n // percent < low or not most:
            continue
        spare = spare_blocks(low, most + 1)
        partner = min(100 * n // percent, high)
        take = min(most, (n + partner) * (100 - percent) // (100 + percent)) + 1 + spare
        block = ((mix(h + np.uint64(band)) >> np.uint64(32)) % np.uint64(most + 1 + spare)).astype(np.int64)
        near = block < take
        block = block[near]
        sums = np.zeros(take, np.uint64)
        np.add.at(sums, block, mix(h[near]))
        full = np.bincount(block, minlength=take) > 0
        key = mix(sums + mix(np.arange(take, dtype=np.uint64) + (np.uint64(band) << np.uint64(40))))
        out.append(key if take - full.sum() > spare else key[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signature(h: np.ndarray) -> int | None:
    """The node of a set."""
    return int(mix(np.array([mix(h).sum() + np.uint64(len(h))], np.uint64)).view(np.int64)[0]) if len(h) else None


def signatures(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n, node, keys) for every row; node is null for a text without words."""

    def make():
        words, ends = WordHash(), size_bands(percent)

        def step(batch):
            sets = [shingles(t, k, words) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "text_hash": batch.column(2), "n": [len(h) for h in sets], "node": [signature(h) for h in sets], "keys": list_array([block_keys(h, percent, ends) for h in sets])}

        return step

    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return by_batches(texts, make, "doc_id long, text_hash long, n long, node long, keys array<long>")


def open_rows(dealt: DataFrame) -> DataFrame:
    """The rows of ``dealt`` (key, node), once each, whose key more than one node has.

    All rows are dealt by key once, and a task looks for a second node in runs of a key. Keys of very many rows are left out
    of this: they pass as they are, be it that rows of one node alone repeat.
    """

    def run(batches):
        held = np.zeros((2, 0), np.int64)  # key and first node of the last run, and whether it is open
        opened = False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "node")))
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[begin, len(key)])
            ok = np.logical_or.reduceat(node != np.repeat(node[begin], size), begin)
            ok[0] |= opened
            held, opened = np.stack([key[begin[-1:]], node[begin[-1:]]]), bool(ok[-1])
            if ok.any():
                ok = np.repeat(ok, size)
                yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(node[ok])], names=["key", "node"])

    glance = dealt.where(F.pmod(F.xxhash64("node"), F.lit(GLANCE)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    hot = keep(glance.where(F.col("n") * GLANCE >= HOT).select("key"), "hot-keys")
    known = None
    if not rows_under(hot, 0):
        known = dealt.join(small(hot, BROADCAST_ROWS), "key", "left_semi")
        dealt = dealt.join(small(hot, BROADCAST_ROWS), "key", "left_anti")
    found = dealt.select("key", "node").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "key long, node long")
    return (found.union(known.select("key", "node")) if known is not None else found).distinct()


def parity(h: np.ndarray) -> bytes:
    """For each of about as many bits as there are hashes, a power of two, whether an odd number of them falls there."""
    bits = 1 << max(6, (len(h) - 1).bit_length())
    odd = np.bincount((h >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parities_differ(x: bytes, y: bytes) -> int:
    """A lower bound of how many hashes one of two sets has alone: bits that differ once the longer parity is folded to the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    least = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def points(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """(node, n, counts, odd, grams) of the nodes in ``wanted`` (doc_id, node), as bytes: the count vector and parity, or if ``whole`` the sorted hashes; others are null."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make():
        words = WordHash()

        def counted(h):
            return np.minimum(np.bincount((h % np.uint64(VECTOR)).astype(np.int64), minlength=VECTOR), 65535).astype(np.uint16).tobytes()

        def step(batch):
            sets = [(node, shingles(t, k, words)) for node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            own = [(node, h) for node, h in sets if signature(h) == node]  # another text may have the same id
            return {
                "node": [node for node, _ in own],
                "n": [len(h) for _, h in own],
                "counts": [None if whole else counted(h) for _, h in own],
                "odd": [None if whole else parity(h) for _, h in own],
                "grams": [h.tobytes() if whole else None for _, h in own],
            }

        return step

    texts = docs.join(small(wanted, BROADCAST_ROWS), "doc_id").select("node", "text")
    return by_batches(texts, make, "node long, n long, counts binary, odd binary, grams binary")


class RTree:
    """Points packed into leaves of ``LEAF`` by size and widest coordinate; each level keeps the upper corner and the sizes."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, comp: np.ndarray, percent: int):
        self.percent, self.order = percent, self._pack(n, counts)
        level = (counts[self.order].astype(np.int64), n[self.order], n[self.order], comp[self.order])
        self.levels = [level]
        while len(level[1]) > LEAF:
            starts = np.arange(0, len(level[1]), LEAF)
            least, most = np.minimum.reduceat(level[3], starts), np.maximum.reduceat(level[3], starts)
            level = (np.maximum.reduceat(level[0], starts), np.minimum.reduceat(level[1], starts), np.maximum.reduceat(level[2], starts), np.where(least == most, least, -1))
            self.levels.append(level)

    @staticmethod
    def _pack(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(n) <= LEAF:
            return np.arange(len(n))
        widest = np.argsort(-counts.astype(np.float32).var(axis=0), kind="stable")[:2]
        slabs = max(1, round((len(n) / LEAF) ** 0.5))
        first = np.argsort(n, kind="stable")
        slab = np.empty(len(n), np.int64)
        slab[first] = np.arange(len(n)) * slabs // len(n)
        return np.lexsort((counts[:, widest[1]], counts[:, widest[0]], slab))

    def _bound(self, level: int, rows: np.ndarray, n: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows may hold a partner, and the bound of the overlap."""
        top, low, high, _ = self.levels[level]
        p, bound = self.percent, np.minimum(top[rows], q).sum(axis=1)
        # saturated counts may hide overlap
        bound = np.where((top[rows] >= 65535).any(axis=1), n, bound)
        ok = ((100 + p) * bound >= p * (n + low[rows])) & (p * low[rows] <= 100 * n) & (100 * high[rows] >= p * n)
        return ok, bound

    def search(self, n: int, q: np.ndarray, comp: int) -> np.ndarray:
        """Positions of all points of other components that pass the bound."""
        rows = np.arange(len(self.levels[-1][1]))
        for level in range(len(self.levels) - 1, -1, -1):
            rows = rows[self.levels[level][3][rows] != comp]
            rows = rows[self._bound(level, rows, n, q)[0]] if len(rows) else rows
            if level:
                rows = (rows[:, None] * LEAF + np.arange(LEAF)).ravel()
                rows = rows[rows < len(self.levels[level - 1][1])]
        return self.order[rows]

    def best(self, n: int, q: np.ndarray, own: int) -> int:
        """A point other than ``own`` with a high bound, found by going down into the best node at each level; -1 if none."""
        rows = np.arange(len(self.levels[-1][1]))
        for level in range(len(self.levels) - 1, -1, -1):
            if not level:
                rows = rows[self.order[rows] != own]
            if not len(rows):
                return -1
            ok, bound = self._bound(level, rows, n, q)
            if not ok.any():
                return -1
            low = self.levels[level][1][rows]
            best = rows[np.argmax(np.where(ok, bound / np.maximum(1, n + low - bound), -1.0))]
            if level:
                rows = np.arange(best * LEAF, min((best + 1) * LEAF, len(self.levels[level - 1][1])))
        return int(self.order[best])


def tree_pairs(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """Candidate pairs (a, b), a < b, of the trees in ``rows`` (tree, node, n, counts, comp, indexed, asks).

    ``every``: all pairs that pass the bound between components; else the most promising partner of each point.
    """

    def run(batches):
        for table in groups_of(batches, "tree"):
            t = table.column("tree").to_numpy()
            node, n, comp = (table.column(c).to_numpy() for c in ("node", "n", "comp"))
            counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16).reshape(len(t), VECTOR)
            indexed, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("indexed", "asks"))
            cuts = np.flatnonzero(np.diff(t)) + 1
            left, right = [], []
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(t)]):
                own = np.arange(lo, hi)[indexed[lo:hi]]
                if not len(own):
                    continue
                tree = RTree(n[own], counts[own], comp[own], percent)
                place = {int(x): i for i, x in enumerate(node[own])}
                for i in np.arange(lo, hi)[asks[lo:hi]]:
                    q = counts[i].astype(np.int64)
                    if every:
                        hits = node[own[tree.search(int(n[i]), q, int(comp[i]))]]
                    else:
                        j = tree.best(int(n[i]), q, place.get(int(node[i]), -1))
                        hits = node[own[j : j + 1]] if j >= 0 else node[:0]
                    left.append(np.minimum(hits, node[i]))
                    right.append(np.maximum(hits, node[i]))
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    dealt = rows.repartition("tree").sortWithinPartitions("tree")
    return dealt.mapInArrow(tidy(run), "a long, b long").where("a <> b").distinct()


def blocks(rest: DataFrame) -> DataFrame:
    """(tree, node, comp, indexed, asks) from the members (key, size, node, comp, main) of keys with several components.

    Those of the main component are indexed alone, the others ask too. Beyond ``TREE`` members both are cut into
    parts of about ``TREE`` rows, and a tree is a part of the indexed with a part of those that ask, so neither grows with the key. Of two
    parts of those that ask, one asks the other.
    """
    asking = F.col("comp") != F.col("main")
    whole = rest.where(F.col("size") <= TREE).select(F.xxhash64("key").alias("tree"), "node", "comp", F.lit(True).alias("indexed"), asking.alias("asks"))
    large = rest.where(F.col("size") > TREE)
    counted = large.groupBy("key").agg(F.count_if(asking).alias("outer"), F.count_if(~asking).alias("inner"))
    dealt = large.join(counted, "key")
    outer, inner = (F.greatest(F.ceil(F.col(c) / TREE), F.lit(1)).cast("int") for c in ("outer", "inner"))
    dealt = dealt.withColumns({"asking": asking, "parts": outer, "own": F.pmod(F.xxhash64("node"), F.when(asking, outer).otherwise(inner)).cast("int"), "inner_parts": inner})
    # kind, indexed part, asking part, and which of the two the row is in
    place = lambda kind, i, q, indexed, asks: F.struct(F.lit(kind).alias("kind"), i.alias("i"), q.alias("q"), indexed.alias("indexed"), asks.alias("asks"))
    yes, no, own = F.lit(True), F.lit(False), F.col("own")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    with_inner = F.transform(each(F.col("inner_parts")), lambda i: place("in", i, own, no, yes))
    with_outer = F.transform(each(F.col("parts")), lambda o: place("out", F.greatest(own, o), F.least(own, o), own >= o, own <= o))
    mains = F.transform(each(F.col("parts")), lambda q: place("in", own, q, yes, no))
    placed = dealt.select("key", "node", "comp", F.explode(F.when(F.col("asking"), F.concat(with_inner, with_outer)).otherwise(mains)).alias("p"))
    return whole.union(placed.select(F.xxhash64("key", "p.kind", "p.i", "p.q").alias("tree"), "node", "comp", "p.indexed", "p.asks"))


def sifted(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose parities differ in no more bits than linked sets may in n-grams. Long texts that share a passage alone go here, before their n-grams are read."""
    side = lambda x: vectors.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def step(batch):
        x, y = (batch.column(c).to_pylist() for c in ("oa", "ob"))
        differ = np.array([parities_differ(u, v) for u, v in zip(x, y)], np.int64)
        total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
        ok = pa.array((100 + percent) * differ <= (100 - percent) * total)
        return {"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok)}

    return by_batches(both.select("a", "b", "na", "nb", "oa", "ob"), lambda: step, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose Jaccard similarity reaches the threshold, counted on the n-grams: (a, b, shared)."""
    grams = sets.select("node", "grams")
    both = pairs.join(grams.withColumnsRenamed({"node": "a", "grams": "ga"}), "a").join(grams.withColumnsRenamed({"node": "b", "grams": "gb"}), "b")

    def make():
        def step(batch):
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("ga", "gb"))
            shared = np.array([len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y)], np.int64)
            union = np.array([len(u) + len(v) for u, v in zip(x, y)], np.int64) - shared
            ok = pa.array(100 * shared >= percent * union)
            return {"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok), "shared": pa.array(shared).filter(ok)}

        return step

    return by_batches(both.select("a", "b", "ga", "gb"), make, "a long, b long, shared long").distinct()


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id).

    Documents link when ``100 * |A & B| >= percent * |A | B|`` over distinct word
    k-grams (A-Z lower-cased, split at ASCII white space; a shorter text is one
    gram). component_id is the smallest doc_id reachable by links, itself
    included. Texts that are null or without words have n_shingles 0 and are
    linked with nothing. Rows that repeat stay and share a component. A row
    with a null id keeps its n_shingles, has a null component_id and links nothing.
    Other columns are not read. An empty table gives an empty result.
    """
    return labelled(docs, k, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``jaccard_join`` with two more columns: text_hash, and comp, which tells components whose smallest ids are equal; null where nothing is linked."""
    marks = keep(signatures(docs, k, percent, id_col, text_col), "shingle-keys")
    named = marks.where("node is not null and doc_id is not null")
    classes = named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))

    copied = keep(classes.where("size > 1").select("node", F.col("rep").alias("leader")), "copied")
    single = named.join(small(copied, BROADCAST_ROWS), "node", "left").where("leader is null or doc_id = leader")
    dealt = single.select("node", F.explode("keys").alias("key"))
    # keys with one node alone that pass here go below
    opened = keep(open_rows(dealt), "members")
    # what is read no more goes, as keys are the most of what is written
    slim = keep(marks.drop("keys"), "sizes")
    classes = slim.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    forget(copied, marks)
    del copied, marks, named, single, dealt
    # trees with the same members: one is enough
    shapes = opened.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.sum(F.hash("node").cast("long")).alias("h1"), F.sum(F.hash(F.col("node") + F.lit(1)).cast("long")).alias("h2"))
    trees = shapes.where("size > 1").groupBy("size", "lo", "h1", "h2").agg(F.min("key").alias("key")).select("key", "size")
    members = keep(opened.join(trees, "key"), "trees")
    forget(opened)

    def described(nodes: DataFrame, whole: bool) -> DataFrame:
        wanted = keep(nodes.distinct().join(classes, "node").select(F.col("rep").alias("doc_id"), "node"), "wanted")
        out = keep(points(docs, wanted, k, id_col, text_col, whole), "grams" if whole else "points")
        forget(wanted)
        return out

    def linked(pairs: DataFrame) -> DataFrame:
        close = keep(sifted(pairs, vectors, percent), "close")
        grams = described(close.select(F.col("a").alias("node")).union(close.select("b")), True)
        out = keep(verified(close, grams, percent), "links")
        forget(grams, close)
        return out

    vectors = described(members.select("node"), False)

    part = F.pmod(F.hash("node"), F.ceil(F.col("size") / TREE))
    first = members.select(F.when(F.col("size") <= TREE, F.col("key")).otherwise(F.xxhash64("key", part)).alias("tree"), "node")
    first = first.join(vectors.select("node", "n", "counts"), "node").select("tree", "node", "n", "counts", F.lit(0).cast("long").alias("comp"), F.lit(True).alias("indexed"), F.lit(True).alias("asks"))
    tried = keep(tree_pairs(first, percent, every=False), "tried")
    release(docs.sparkSession)
    links = linked(tried)

    comp = keep(components(links.select("a", "b")), "components")
    placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("key", "size", "comp").count().groupBy("key", "size").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    rest = keep(placed.join(mixed.select("key", "main"), "key"), "mixed")
    if not rows_under(rest, 0):
        again = blocks(rest).join(vectors.select("node", "n", "counts"), "node").select("tree", "node", "n", "counts", "comp", "indexed", "asks")
        fresh = keep(tree_pairs(again, percent, every=True).join(tried, ["a", "b"], "left_anti"), "tried")
        links = links.union(linked(fresh))
        comp = keep(components(links.select("a", "b")), "components")

    reached = comp.join(classes, "node")
    least = reached.groupBy("comp").agg(F.min("rep").alias("component_id"))
    alone = classes.join(comp, "node", "left_anti").where("size > 1").select("node", F.col("rep").alias("component_id"), F.col("node").alias("comp"))
    target = reached.join(least, "comp").select("node", "component_id", "comp").union(alone)
    out = slim.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node").join(target, "node", "left")
    named = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(named, F.coalesce("component_id", "doc_id")).alias("component_id"), "text_hash", F.when(named, F.col("comp")).alias("comp"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, without those that are linked with another that stays: one of each component does.

    It is the one of the smallest doc_id, and of texts that share it one. Id and text tell a document, so another text
    under the same id is judged on its own; of rows that repeat both, one stays. Rows with a null id come after all
    others. Null and wordless texts are linked with nothing and all stay. An empty table stays empty; columns of any
    name may be there.
    """
    text, bits = F.xxhash64(F.col(text_col).cast("string")), (1 << 62) - 1
    own = F.coalesce(F.col(id_col).cast("long"), text.bitwiseAND(F.lit(bits)) + F.lit(bits + 1))
    groups = labelled(docs.select(own.alias("doc_id"), F.col(text_col).cast("string").alias("text")), k, percent, "doc_id", "text")
    linked = groups.where("comp is not null").groupBy("comp", F.struct("doc_id", "text_hash").alias("row")).agg(F.count("*").alias("n"))
    linked = keep(linked, "linked")
    leads = linked.groupBy("comp").agg(F.min("row").alias("lead"))
    number, hashed = fresh(docs, "number", "hash")
    rows = lambda df: df.select(F.col("row.doc_id").alias(number), F.col("row.text_hash").alias(hashed))
    same = (own == F.col(number)) & (text == F.col(hashed))
    left = docs.join(rows(linked.join(leads, "comp").where("row <> lead")), same, "left_anti")
    twice = keep(rows(linked.where("n > 1")), "repeated")
    if rows_under(twice, 0):
        return left
    repeated = left.join(small(twice, BROADCAST_ROWS), same, "inner").dropDuplicates([number, hashed]).select(docs.columns)
    return left.join(small(twice, BROADCAST_ROWS), same, "left_anti").union(repeated)
