"""SimHash near-dedup by a self-join of binary tries.

Fingerprint: words of the text, A-Z lower-cased, form shingles of ``width`` words, repeats included, joined by single spaces (a text of
fewer words is one shingle); a bit is 1 where more than half of the shingles' XXH64 hashes (seed 42) have it.  No words: zero.
Fingerprints link where they differ in at most ``k`` bits.

Join: distinct fingerprints, each with the smallest id that has it, are the leaves of a binary trie.  Pairs of nodes of one depth are traversed
together from the top: equal sides of a pair keep its differing bits, crossed sides add one, and a pair goes as soon as its
bits exceed the budget.  Small pairs of nodes are compared leaf by leaf.  The budget grows with depth: there are ``ROTATIONS`` tries, each of the
fingerprints rotated by another share of their bits.  Of two fingerprints that differ in k bits some rotation has at most k * i / ROTATIONS of these
in its first i shares, for every i (a ring of numbers has a start from which no running mean exceeds the mean), so each trie allows no more.

Distribution: the trie's top ``c`` bits are cut off, with c so that a node there has some ``LEAVES`` fingerprints; each pair of nodes
within the budget is a group of its own that holds both nodes' leaves.  A fingerprint goes to 1 + c groups a trie while c is at most 16.  Pairs of which
a node is crowded are cut deeper, so similar fingerprints in great numbers don't meet in one task.  Inside a group, leaves that are connected already
form one class, and pairs of nodes that lie whole in one class go; so a dense cluster costs no square of its size, and a group returns at most one
row a leaf (leaf, class), never its pairs.  Components over those rows follow.

Cases: null and empty texts have fingerprint zero, which links like any other; equal texts are one leaf; repeated rows of an id are one vertex with the links of all of them;
a row with a null id has a fingerprint, a null component and links with nothing; texts of any length are read whole; other columns aren't
read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, at_rest, components, small_batches, small_or_shuffled, spread_join, union

WIDTH, BITS, ROTATIONS = 4, 64, 4
#: Leaves of a node where the trie is cut, on average; nodes with CROWDED times as many are cut deeper, down to DEEPEST bits.
LEAVES, CROWDED, DEEPEST = 2048, 2, 24
#: Pairs of nodes that a task takes up at a time, pairs of leaves below which two nodes are compared leaf by leaf.
FRONTIER, SMALL = 1 << 16, 16
#: Shingles whose bits are counted at a time.
SLICE = 1 << 14
digest = xxhash.xxh64_intdigest


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[-n:]
    ones, at = np.zeros(BITS, "i8"), 0
    while at < n:
        a, b = first[at : min(n, at + SLICE)].tolist(), last[at : at + SLICE].tolist()
        h = np.fromiter((digest(whole[i:j], 42) for i, j in zip(a, b)), "<u8", len(a))
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
        at += SLICE
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def budget(depth: int, k: int) -> int:
    """Most differing bits of two nodes of a depth."""
    return k * -(-depth * ROTATIONS // BITS) // ROTATIONS


def masks(c: int, k: int, top: int = 0, of: int = 0, spent: int | None = None) -> np.ndarray:
    """Differences between nodes of depth c that the budget allows at each depth; those below a difference ``top`` of depth ``of``, if given."""
    found = [(top, top.bit_count() if spent is None else spent)]
    for depth in range(of + 1, c + 1):
        most = budget(depth, k)
        found = [(m << 1 | bit, n + bit) for m, n in found for bit in (0, 1) if n + bit <= most]
    return np.array([m for m, _ in found], "u8")


def rotated(v: np.ndarray, t: int) -> np.ndarray:
    s = np.uint64(t * BITS // ROTATIONS)
    return v << s | v >> np.uint64(BITS) - s if s else v


class Classes:
    """Connected leaves of a group; each class is named by its least place."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.moved()

    def moved(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.of[1:] != self.of[:-1])])

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        of, tied = self.of, False
        while True:
            a, b = of[i], of[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b, tied = i[open_], j[open_], a[open_], b[open_], True
            np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
            while (up := of[of]).tolist() != of.tolist() if len(of) < 64 else not np.array_equal(up := of[of], of):
                of = up
        if tied:
            self.of = of
            self.moved()

    def one(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether all leaves of each range are of one class."""
        return self.changes[high - 1] == self.changes[low]


def joined(v: np.ndarray, k: int, depth: int, spent: int, split: int) -> np.ndarray:
    """Class of each of the sorted leaves ``v`` of two nodes of a depth (the second starts at ``split``) or of one node (split 0).

    Leaves are tied through links between the nodes (within the one node) and through neighbours of the order."""
    n, classes = len(v), Classes(len(v))
    for t in range(ROTATIONS):  # leaves next to each other in some order, which are most of a cluster
        order = np.argsort(rotated(v, t), kind="stable")
        near = np.bitwise_count(v[order[1:]] ^ v[order[:-1]]) <= k
        classes.tie(order[1:][near], order[:-1][near])
    start = (0, n, 0, n) if not split else (0, split, split, n)
    stack = [(depth, *(np.array([x]) for x in (*start, spent)))]
    while stack:
        depth, al, ah, bl, bh, d = stack.pop()
        if len(al) > FRONTIER:
            stack.append((depth, *(x[FRONTIER:] for x in (al, ah, bl, bh, d))))
            al, ah, bl, bh, d = (x[:FRONTIER] for x in (al, ah, bl, bh, d))
        open_ = ~(classes.one(al, ah) & classes.one(bl, bh) & (classes.of[al] == classes.of[bl]))
        al, ah, bl, bh, d = (x[open_] for x in (al, ah, bl, bh, d))
        size = (ah - al) * (bh - bl)
        leaf = size <= SMALL if depth < BITS else size > 0
        if leaf.any():
            a, wide, of = al[leaf], (bh - bl)[leaf], size[leaf]
            at = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
            i, j = np.repeat(a, of) + at // np.repeat(wide, of), np.repeat(bl[leaf], of) + at % np.repeat(wide, of)
            near = np.bitwise_count(v[i] ^ v[j]) <= k
            classes.tie(i[near], j[near])
        al, ah, bl, bh, d = (x[~leaf] for x in (al, ah, bl, bh, d))
        if not len(al):
            continue
        bit = np.uint64(BITS - 1 - depth)
        middle = lambda low, high: np.clip(np.searchsorted(v, (v[low] >> bit | np.uint64(1)) << bit), low, high)  # noqa: E731, B023
        am, bm = middle(al, ah), middle(bl, bh)
        one = al == bl
        kids = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1)]
        kids = [np.concatenate(x) for x in zip(*kids, tuple(x[~one] for x in (am, ah, bl, bm, d + 1)))]
        keep = (kids[4] <= budget(depth + 1, k)) & (kids[1] > kids[0]) & (kids[3] > kids[2])
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in kids)))
    return classes.of


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): each row's fingerprint as a signed 64-bit number.  One pass, no shuffle."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, width) for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, "u8").view("i8"), pa.int64())], names=["id", "fp"])
        at_rest()

    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _crowded(leaves: DataFrame, c: int, limit: int) -> dict[tuple[int, int], int]:
    """(trie, node of depth c) -> how many bits deeper it is cut.  At most ROTATIONS * 2 ** c nodes, with c of at most 16."""
    node = lambda t: F.shiftrightunsigned(F.col("fp") if not t else F.shiftleft("fp", t * BITS // ROTATIONS).bitwiseOR(F.shiftrightunsigned("fp", BITS - t * BITS // ROTATIONS)), BITS - c) if c else F.lit(0).cast("long")
    at = leaves.select(F.posexplode(F.array(*map(node, range(ROTATIONS)))).alias("t", "node"))
    many = at.groupBy("t", "node").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED * limit).collect()
    return {(r.t, r.node): min(DEEPEST - c, math.ceil(math.log2(r.n / limit))) for r in many}


def _dealt(leaves: DataFrame, c: int, k: int, crowded: dict[tuple[int, int], int]) -> DataFrame:
    """Rows (t, depth, p, q, v, rep): the leaves of each pair p <= q of nodes of a depth in trie t."""
    near = masks(c, k)
    deeper = {(int(m), e): masks(c + e, k, int(m), c) for e in {*crowded.values()} for m in near}

    def run(batches):
        cut_deeper = [np.zeros(1 << c, "i8") for _ in range(ROTATIONS)]
        for (t, node), e in crowded.items():
            cut_deeper[t][node] = e
        for b in batches:
            fp, rep = b.column(0).to_numpy().view("u8"), b.column(1)
            for t in range(ROTATIONS):
                v = rotated(fp, t)
                p = v >> np.uint64(BITS - c) if c else np.zeros(len(v), "u8")
                for m in near:
                    e = np.maximum(cut_deeper[t][p.astype("i8")], cut_deeper[t][(p ^ m).astype("i8")])
                    for extra in np.unique(e):
                        rows = np.flatnonzero(e == extra)
                        depth = c + int(extra)
                        own = v[rows] >> np.uint64(BITS - depth) if depth else np.zeros(len(rows), "u8")
                        for below in deeper[int(m), int(extra)] if extra else [m]:
                            other = own ^ below
                            low, high = np.minimum(own, other), np.maximum(own, other)
                            fixed = [pa.array(np.full(len(rows), x, "i4")) for x in (t, depth)]
                            yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(x.view("i8")) for x in (low, high, v[rows])), rep.take(pa.array(rows))], names=["t", "depth", "p", "q", "v", "rep"])

    return leaves.select("fp", "rep").mapInArrow(run, "t int, depth int, p long, q long, v long, rep long")


def links(leaves: DataFrame, k: int) -> DataFrame:
    """Rows (a, b): leaves (by their ids) that are connected, at most one row a leaf and group, not distinct.

    ``leaves``: rows (fp, rep) of distinct fingerprints, a written table.
    """
    n = leaves.count()
    c = min(BITS // ROTATIONS, max(0, math.ceil(math.log2(max(1, n / LEAVES)))))
    dealt = _dealt(leaves, c, k, _crowded(leaves, c, max(LEAVES, n >> c)))
    spare = np.array([budget(depth, k) for depth in range(BITS + 1)])

    def run(batches):
        held, parts = None, []

        def done():
            if held is None:
                return
            v, rep = (np.concatenate(x) for x in zip(*parts))
            _, depth, p, q = held
            order = np.argsort(v)
            v, rep = v[order], rep[order]
            split = 0 if p == q else int(np.searchsorted(v, np.uint64(q) << np.uint64(BITS - depth)))
            if len(v) < 2 or p != q and split in (0, len(v)):
                return
            spent = (p ^ q).bit_count()
            assert spent <= spare[depth]
            of = joined(v, k, depth, spent, split)
            least = rep.copy()
            np.minimum.at(least, of, rep)
            tied = np.flatnonzero(rep != least[of])
            for at in range(0, len(tied), 1 << 16):
                some = tied[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(least[of[some]])], names=["a", "b"])

        for b in batches:
            keys = [b.column(i).to_numpy() for i in range(4)]
            v, rep = b.column(4).to_numpy().view("u8"), b.column(5).to_numpy()
            if not len(v):
                continue
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) + 1).tolist(), len(v)]
            for i, j in zip(cuts, cuts[1:]):
                key = tuple(int(x[i]) for x in keys)
                if key != held:
                    yield from done()
                    held, parts = key, []
                parts.append((v[i:j], rep[i:j]))
        yield from done()
        at_rest()

    group = ["t", "depth", "p", "q"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def link(docs: DataFrame, width: int = WIDTH, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): 16 hex digits, and the smallest id that links reach from the row."""
    if not 0 <= k < BITS:
        raise ValueError("k must be from 0 to 63")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(fingerprints(docs, width, id_col, text_col), "simhash")
    known = rows.filter("id is not null")
    leaves = scratch.written(known.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "leaves")
    edges = [links(leaves, k).distinct()]
    # an id with several fingerprints ties them
    several = known.groupBy("id").agg(F.count_distinct("fp").alias("n")).filter("n > 1").select("id")
    edges.append(known.join(small_or_shuffled(several), "id", "left_semi").join(leaves, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct())
    of = components(union(edges), scratch=scratch)
    named = leaves.join(small_or_shuffled(of.withColumnRenamed("id", "rep")), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"), "copies")
    named = scratch.written(named, "named-leaves")
    out = spread_join(rows, named, ["fp"], "copies", F.xxhash64("id"))
    scratch.drop(but=(rows, named))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
