"""N-gram Jaccard join by PartEnum signatures.

A document's set is the set of its distinct word shingles.  Sets whose Jaccard
similarity is at least p / q have sizes within that ratio, so sizes are cut into
bands of it and only equal or neighbouring bands can link; within a pair of bands,
linked sets of sizes a and b differ in at most (a + b)(q - p) / (q + p) features.

The feature domain is cut by hash into groups, and each group into cells.  Where k
differences are possible there are G = floor(k / 2) + 1 + m groups, so some group has at
most one; of its subsets of all its cells but one, one is then equal in both sets, and each such
subset is a signature.  As PartEnum asks, the numbers depend on the band: four cells and
no spare group (m = 0) where sets are small, two cells and spare groups where they are large.
A difference takes away the most equal subsets where groups get one or two each, which leaves
at least 2G - k > 2m of them.  So subsets with few features are left out if a set has at most 2m
of those: one of the equal subsets is then left, and whether a subset counts as weak
depends on its content alone, so both sets keep it.  Sets that have more weak subsets send
all of them.  So linked sets always share a signature; each pair that is taken up is
verified on its whole sets.

Equal sets are one set from the start.  Pairs are not expanded where they can't
change the outcome: rounds of verification take each set's most promising
partner, connected components follow, and at last only pairs of sets that share a
signature and are still unconnected are verified, all of them.

Signatures that very many sets share are found on a small sample of the documents
first; their rows are dealt out over many tasks, each chains its part, and the parts'
first members are tied.  The sample decides on the dealing alone: a signature that it
misses has its rows in one task, with the same result.

Shingles are compared as 64-bit hashes, equal sets by 128 bits.

Cases: a text with fewer words than a shingle is one shingle; null and empty
texts have the empty set and link with nothing; rows of one id are one vertex, a
null id links with nothing; texts of any length are read whole, in time linear in it, and send as many signatures as their
set's size asks for; pairs at exactly p / q link; of equally promising partners the one of smaller id is tried first, which
changes no result; columns other than id and text aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, at_rest, components, small_batches, small_or_shuffled, spread_join

#: Bands with up to this number of possible differences have groups of four cells, others of two.
FEW = 15
#: Spare groups, as a share of the others, of groups of two cells.
SPARE = 0.25
CACHE = 100_000
#: Equal sets that a task has met already send no signatures again.
SEEN = 100_000
#: Documents whose sets a worker holds at a time.
SLICE = 500
#: A signature of more than this share of the documents (and HOT_ROWS) is dealt out over several tasks.
HOT_SHARE, HOT_ROWS, HOT_SEEN = 1 / 1000, 1000, 16
#: Bits of a set's parity sketch, in words of 64.
SKETCH_WORDS = 16
#: The same of the wider sketch that pairs are bounded by before their sets are moved.
WIDE_WORDS = 256
ROUNDS = 2


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


hash_of = WordHashes()


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    h = np.fromiter(map(hash_of.__getitem__, words), "u8", len(words))
    with np.errstate(over="ignore"):
        n = max(1, len(h) - width + 1)
        out = np.full(n, np.uint64(len(h) if len(h) < width else width))
        for k in range(min(width, len(h))):
            out = mix(out * np.uint64(0x100000001B3) ^ h[k : k + n], 7)
    return np.unique(out)


class PartEnum:
    """Signatures for Jaccard similarity of at least p / q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.low = [1]

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            at = self.low[-1]
            self.low.append(max(at, at * self.q // self.p) + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019  one object a task
    def scheme(self, band: int) -> tuple[int, int, int, int, int]:
        """Of pairs whose smaller set is in the band: most differences k, groups, cells in a group, spare groups m, most features of a weak subset."""
        first, last = self.low[band], self.low[band + 1] - 1
        largest = last * self.q // self.p
        k = (last + largest) * (self.q - self.p) // (self.q + self.p)
        n, cells = k // 2 + 1, 4 if k <= FEW else 2
        if k <= FEW:
            return k, n, cells, 0, -1
        m = math.ceil(SPARE * n)
        mean, weak, mass = first * (cells - 1) / ((n + m) * cells), -1, 0.0
        while (mass := mass + math.exp(-mean) * mean ** (weak + 1) / math.factorial(weak + 1)) <= 0.6 * 2 * m / (cells * (n + m)):
            weak += 1
        return k, n + m, cells, m, weak

    def signatures(self, s: np.ndarray) -> np.ndarray:
        out, own = [np.empty(0, "u8")], self.band(len(s))
        for band in (own, own - 1):
            if band < 0 or band < own and (self.low[own] - 1) * self.q // self.p < len(s):
                continue
            k, groups, cells, m, weak = self.scheme(band)
            if not k:
                continue  # only equal sets
            n = groups * cells
            cell = (mix(s, 11) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
            cell = cell.astype("i8")
            v = mix(s, 13)
            total = np.bincount(cell, (v & np.uint64(0xFFFFFFFF)).astype("f8"), n).astype("u8") + (np.bincount(cell, (v >> np.uint64(32)).astype("f8"), n).astype("u8") << np.uint64(32))
            total = total.reshape(groups, cells)
            # a sum over all cells of a group but one
            sig, tag = (total.sum(1, keepdims=True) - total).reshape(-1), np.arange(n, dtype="u8")
            if m:
                held = np.bincount(cell, minlength=n).reshape(groups, cells)
                full = held.sum(1, keepdims=True) - held > weak
                if (~full).sum() <= 2 * m:
                    sig, tag = sig[full.reshape(-1)], tag[full.reshape(-1)]
            out.append(mix(sig ^ mix(tag + (np.uint64(band) << np.uint64(32)), 17), 19))
        return np.concatenate(out)


def sketch(s: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity of the number of features in each of 64 * words buckets, as bits of signed words.

    Two sets differ in at least as many features as their sketches in bits.
    """
    bucket = (mix(s, 23) % np.uint64(64 * words)).astype("i8")
    return np.packbits((np.bincount(bucket, minlength=64 * words) & 1).astype("u1")).view("i8")


def sliced(batches):
    """Arrow batches cut into slices of bounded length."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _digests(docs: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """Rows (id, n, h1, h2, sketch, sigs): size, 128-bit hash, parity sketch and signatures of each row's set, from one
    pass over the texts.  Rows without an id, and sets that the same task has met with one, send no signatures."""

    def run(batches):
        scheme, seen = PartEnum(p, q), set()
        for b in sliced(batches):
            n, h1, h2, marks, sigs = [], [], [], [], []
            for id, text in zip(b.column(0), b.column(1)):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                h1.append(mix(s, 3).sum(dtype="u8").astype("i8"))
                h2.append(mix(s, 5).sum(dtype="u8").astype("i8"))
                marks.append(sketch(s))
                key = int(h1[-1]), int(h2[-1])
                if len(s) and id.is_valid and key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    sigs.append(scheme.signatures(s).astype("i8"))
                else:
                    sigs.append(np.empty(0, "i8"))
            sketches, signatures = (pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in rows]), pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64())) for rows in (marks, sigs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), sketches, signatures], names=["id", "n", "h1", "h2", "sketch", "sigs"])
        at_rest(hash_of)

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, sketch array<long>, sigs array<long>")


def _signatures(digests: DataFrame) -> DataFrame:
    """Rows (sig, id)."""
    return digests.select(F.explode("sigs").alias("sig"), "id")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Rows (id, size, wide, features) of the ids' sets."""

    def run(batches):
        for b in sliced(batches):
            sets = [shingles(x.as_py(), width) for x in b.column(1)]
            wide, features = (pa.array(x, pa.list_(pa.int64())) for x in ([sketch(s, WIDE_WORDS) for s in sets], [s.astype("i8") for s in sets]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), wide, features], names=["id", "size", "wide", "features"])
        at_rest(hash_of)

    return docs.join(small_or_shuffled(ids), "id", "left_semi").mapInArrow(run, "id long, size long, wide array<long>, features array<long>")


def _marks(sizes: DataFrame) -> DataFrame:
    """Rows (id, size, w0, w1, ...): one for each row of an id."""
    return sizes.filter("n > 0 and id is not null").select("id", F.col("n").alias("size"), *[F.col("sketch")[k].alias(f"w{k}") for k in range(SKETCH_WORDS)])


def _possible(a: str, b: str, p: int, q: int) -> F.Column:
    """Whether sizes and sketches (columns with these prefixes) leave it possible that two sets link."""
    bits = F.lit(0)
    for k in range(SKETCH_WORDS):
        bits = bits + F.bit_count(F.col(f"{a}w{k}").bitwiseXOR(F.col(f"{b}w{k}")))
    x, y = F.col(f"{a}size"), F.col(f"{b}size")
    return (bits * (q + p) <= (x + y) * (q - p)) & (F.least(x, y) * q >= F.greatest(x, y) * p)


def _verified(pairs: DataFrame, docs: DataFrame, width: int, p: int, q: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; only these pairs' texts are read as sets."""
    ids = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
    sets = scratch.written(_sets(docs, ids, width), "involved-sets")
    # sets may be long, so pairs meet their wide sketches first; nothing here groups by a, so that a hot one's join can be split
    bounded = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("wide").alias("wb")), "b")
    bounded = bounded.join(sets.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("wide").alias("wa")), "a")
    bits = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    likely = scratch.written(bounded.filter(bits * (q + p) <= (F.col("na") + F.col("nb")) * (q - p)).select("a", "b"), "likely-pairs")
    both = likely.join(sets.select(F.col("id").alias("b"), F.col("features").alias("fb")), "b").join(sets.select(F.col("id").alias("a"), F.col("features").alias("fa")), "a")
    na, nb = F.size("fa"), F.size("fb")
    common = F.size(F.array_intersect("fa", "fb"))
    out = scratch.written(both.filter(common * (p + q) >= p * (na + nb)).select("a", "b"), "verified")
    scratch.drop(ids, sets, likely)
    return out


def _hot(docs: DataFrame, rows: int, width: int, p: int, q: int) -> DataFrame | None:
    """Rows (sig, parts): signatures that a sample of the documents shows to be shared by very many, and the number of
    tasks for each.  At most rows * (signatures a document) / limit of them."""
    limit = max(HOT_ROWS, int(rows * HOT_SHARE))
    every = max(1, limit // HOT_SEEN)
    if rows <= limit:
        return None
    some = docs.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    return _signatures(_digests(some, width, p, q)).groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_SEEN).select("sig", F.ceil(F.col("n") * every / (limit / 8)).cast("int").alias("parts"))


def _dealt(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows (sig, id) with the part of the signature that they belong to and whether it is hot."""
    if hot is None:
        return rows.withColumns({"part": F.lit(0), "hot": F.lit(False)})
    met = rows.join(small_or_shuffled(hot), "sig", "left")
    several = F.coalesce(F.col("parts") > 1, F.lit(False))
    return met.select("sig", "id", F.when(several, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).otherwise(F.lit(0)).alias("part"), several.alias("hot"))


def _shared(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The rows (sig, id) whose signature isn't theirs alone."""
    counted = _dealt(rows, hot).withColumn("n", F.count("*").over(Window.partitionBy("sig", "part")))
    return counted.filter("n > 1 or hot").select("sig", "id")


def _chained(shared: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows (sig, id, before, first): members of each signature with the one before and the first, hot signatures in parts
    whose first members have the signature's smallest member before them.  Signatures with a single member are left out."""
    rows = _dealt(shared, hot)
    by = Window.partitionBy("sig", "part")
    order = by.orderBy("id")
    rows = rows.withColumns({"before": F.lag("id").over(order), "first": F.first("id").over(order), "n": F.count("*").over(by)}).filter("n > 1 or hot")
    if hot is None:
        return rows.select("sig", "id", "before", "first")
    least = rows.filter("hot and before is null").groupBy("sig").agg(F.min("id").alias("least"))
    rows = rows.join(small_or_shuffled(least), "sig", "left")
    tied = F.when(F.col("before").isNull() & (F.col("least") < F.col("id")), F.col("least"))
    return rows.select("sig", "id", F.coalesce("before", tied).alias("before"), "first")


def link(docs: DataFrame, width: int = 5, p: int = 4, q: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): each row's set size and the smallest id that links reach from it.

    Two documents link when the Jaccard similarity of their sets is at least p / q.
    """
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession)
    digests = scratch.written(_digests(docs, width, p, q), "set-digests")
    sizes = scratch.written(digests.drop("sigs"), "set-sizes")
    known = sizes.filter("n > 0 and id is not null")
    groups = scratch.written(known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "equal-sets")
    # copies of an equal set, each with the smallest id among them
    moved = scratch.written(spread_join(known.select("id", "h1", "h2"), groups, ["h1", "h2"], "copies", F.xxhash64("id"), inner=True).filter("id <> rep").select("id", "rep").distinct(), "copies")
    # a copy stands for its representative in all that follows, unless its id has other rows too: those ids are tied by edges
    several = known.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id")
    ties = scratch.written(moved.join(several, "id", "left_semi"), "tied-copies")
    stand = scratch.written(moved.join(small_or_shuffled(ties.select("id").distinct()), "id", "left_anti"), "stand-ins")
    senders = docs.filter("id is not null")
    hot = _hot(senders, known.count(), width, p, q)
    if hot is not None:
        hot = scratch.written(hot, "hot-signatures")
    shared = scratch.written(_shared(_signatures(digests), hot), "shared-signatures")
    scratch.drop(digests)
    of_reps = shared.join(small_or_shuffled(stand), "id", "left").select("sig", F.coalesce("rep", "id").alias("id")).distinct()
    chained = scratch.written(_chained(of_reps, hot), "chained-signatures")
    scratch.drop(shared)
    marks = _marks(sizes)
    partners = chained.filter("before is not null").select(F.explode(F.array_distinct(F.array("before", "first"))).alias("a"), F.col("id").alias("b")).filter("a <> b")
    pairs = partners.groupBy("a", "b").agg(F.count("*").alias("shared"))
    for end in "ab":
        pairs = pairs.join(marks.toDF(end, *[f"{end}_{c}" for c in marks.columns[1:]]), end)
    pairs = scratch.written(pairs.filter(_possible("a_", "b_", p, q)).select("a", "b", "shared"), "chained-pairs")
    edges, of = ties.select(F.col("rep").alias("a"), F.col("id").alias("b")), None
    for k in range(ROUNDS):
        open_pairs = pairs if of is None else _apart(pairs, of)
        best = scratch.written(open_pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b"), "best-pairs")
        found = _verified(best, docs, width, p, q, scratch)
        now = scratch.written(components(edges.unionByName(found) if of is None else found, of, scratch), "components")
        if k + 1 < ROUNDS:
            pairs = scratch.written(open_pairs.join(best, ["a", "b"], "left_anti"), "open-pairs")
            scratch.drop(but=(sizes, groups, stand, chained, pairs, now))
        of = now
    rest = scratch.written(_unconnected(chained.select("sig", "id"), of, marks, p, q, scratch), "unconnected")
    if rest.limit(1).count():
        of = scratch.written(components(_verified(rest, docs, width, p, q, scratch), of, scratch), "components")
    # every stand-in has its representative's component
    named = groups.groupBy("rep").agg(F.sum("copies").alias("copies")).join(of.toDF("rep", "component"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "copies")
    one = spread_join(stand, named, ["rep"], "copies", F.xxhash64("id"), inner=True).select("id", "component").unionByName(of)
    labels = scratch.written(one, "labels")
    out = sizes.join(small_or_shuffled(labels), "id", "left")
    scratch.drop(but=(sizes, labels))
    alone = F.when(F.col("n") > 0, F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(alone, "id").alias("component_id"))


def _apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs whose ends aren't connected yet."""
    out = pairs.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
    return out.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(pairs.columns)


def _unconnected(rows: DataFrame, of: DataFrame, marks: DataFrame, p: int, q: int, scratch: Scratch) -> DataFrame:
    """Every pair (a, b), a < b, of rows (sig, id) with a signature in common and no connection yet
    whose sizes and sketches leave it possible that they link.

    In each signature's group the members of its largest component meet the others,
    never each other; so a group of near copies that is connected by now costs nothing.
    """
    sizes = of.groupBy("component").agg(F.count("*").alias("members"))
    own = rows.join(of, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component")).join(sizes, "component", "left").select("sig", "id", "component", F.coalesce("members", F.lit(1)).alias("members"))
    own = scratch.written(own, "signature-components")
    main = own.groupBy("sig").agg(F.max(F.struct("members", "component"))["component"].alias("main"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_rows = scratch.written(own.join(main.select("sig", "main"), "sig").select("sig", "id", "component", "main").join(marks, "id"), "open-signatures")
    scratch.drop(own)
    few = open_rows.filter("component <> main").drop("main")
    few = few.toDF(*[c if c == "sig" else f"x_{c}" for c in few.columns])
    others = open_rows.drop("main").withColumnRenamed("sig", "y_sig")
    met = few.join(others, (F.col("sig") == F.col("y_sig")) & (F.col("x_component") != F.col("component")) & _possible("x_", "", p, q))
    return met.select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")).distinct()
