"""Bins of self-identical sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .intervals import BUCKET, range_join

K = 21
#: One k-mer in so many is kept in a window's sketch.
SKETCH = 8
#: Windows in a block of the identity matrix.
BLOCK = 64
#: Letters whose k-mers are made at once.
LETTERS = 1 << 20
#: Two bits a base; anything else ends a k-mer.
BASES = "ACGT"


def kmers(seq: str, k: int = K, sketch: int = SKETCH) -> np.ndarray:
    """Sorted distinct k-mers of a sequence, of at most 31 bases, each the lesser of itself and its reverse complement; of these one in ``sketch``, picked by a hash."""
    return _kmers([seq], k, sketch)[1]


def _kmers(seqs: list[str], k: int, sketch: int) -> tuple[np.ndarray, np.ndarray]:
    """How many k-mers each sequence has, and all these, by one pass over the joined sequences."""
    table = np.full(256, 4, "u1")
    for n, base in enumerate(BASES):
        table[ord(base)] = table[ord(base.lower())] = n
    sizes = np.array([len(x) for x in seqs], "i8")
    codes = table[np.frombuffer("".join(seqs).encode("latin-1", "replace"), "u1")]
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(len(seqs), "i8"), np.empty(0, "i8")
    other = np.concatenate([[0], np.cumsum(codes == 4)])
    codes = np.where(codes == 4, 0, codes).astype("u8")
    forward, back = np.zeros(n, "u8"), np.zeros(n, "u8")
    for t in range(k):
        forward = forward << np.uint64(2) | codes[t : t + n]
        back |= np.uint64(3) - codes[t : t + n] << np.uint64(2 * t)
    row = np.repeat(np.arange(len(seqs)), sizes)
    whole = (other[k:] == other[:n]) & (row[:n] == row[k - 1 :])  # no other letter, and all in one sequence
    found, row = np.minimum(forward, back)[whole], row[:n][whole]
    if sketch > 1:
        with np.errstate(over="ignore"):
            h = (found ^ found >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        kept = (h ^ h >> np.uint64(31)) % np.uint64(sketch) == 0
        found, row = found[kept], row[kept]
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=len(seqs)), found[new].astype("i8")


def _pieces(sizes: np.ndarray, most: int) -> list[int]:
    """Where runs of neighbours begin that add up to ``most`` or are one, and the end."""
    cuts, sum_ = [0], 0
    for n, size in enumerate(sizes.tolist()):
        if n > cuts[-1] and sum_ + size > most:
            cuts.append(n)
            sum_ = 0
        sum_ += size
    return [*cuts, len(sizes)] if len(sizes) else cuts


def self_identity(chunks: DataFrame, window: int, least: float = 0.0, band: int | None = None, k: int = K, sketch: int = SKETCH) -> DataFrame:
    """Rows (region_id, i, j, st, end, other_st, other_end, ident), i < j: pairs of a region's windows that share k-mers, of either strand, with an identity
    above ``least``; windows are numbered by their place, those further apart than ``band`` windows are left out.

    Identity is estimated from the containment c of the windows' k-mer sketches as c ** (1 / k), in per cent.
    ``chunks``: (region_id, st, seq), a row for each window of the sequence.

    The matrix of all pairs is made block by block: each pair of blocks of BLOCK windows is a group, whose shared k-mers are
    counted by one product of the windows' k-mer vectors, so a k-mer that all windows have costs no more than any other.
    Groups stream through tasks in their order, and small ones share a product, as regions of a few windows are many.
    """
    code = "int" if 2 * k < 32 else "long"

    @F.arrow_udf(f"array<{code}>")
    def sketches(seqs: pa.Array) -> pa.Array:
        texts, kind = [x or "" for x in seqs.to_pylist()], pa.int32() if code == "int" else pa.int64()
        cuts = _pieces(np.array([len(x) for x in texts], "i8"), LETTERS)
        made = [_kmers(texts[a:b], k, sketch) for a, b in zip(cuts, cuts[1:])]
        ends = np.cumsum(np.concatenate([[0], *(n for n, _ in made)]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, "i8"), *(x for _, x in made)]), kind))

    own = Window.partitionBy("region_id")
    rows = chunks.select("region_id", F.col("st").cast("long").alias("st"), F.coalesce(F.length("seq"), F.lit(0)).alias("size"), sketches("seq").alias("s")).withColumns({"low": F.min("st").over(own), "high": F.max("st").over(own)})
    place = lambda st: F.floor((F.col(st) - F.col("low")) / window)
    rows = rows.select("region_id", "st", "size", "s", place("st").alias("i"), F.floor(place("st") / BLOCK).alias("block"), F.floor(place("high") / BLOCK).alias("last"))
    reach = None if band is None else -(-band // BLOCK)
    first, last = F.lit(0).cast("long"), F.col("last")
    near = F.sequence(first, last) if reach is None else F.sequence(F.greatest(F.col("block") - reach, first), F.least(F.col("block") + reach, last))
    rows = rows.select("*", F.explode(near).alias("other")).select("region_id", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "i", "st", "size", "s")
    kind = dict(chunks.dtypes)["region_id"]
    out = f"region_id {kind}, i long, j long, st long, end long, other_st long, other_end long, ident double"
    names = [c.split()[0] for c in out.split(", ")]

    def meet(own: pa.Table, groups: np.ndarray) -> pa.RecordBatch:
        """Pairs of whole groups; ``groups``: where each begins, and the end."""
        i, block, a, b, st, size = (own.column(c).to_numpy() for c in ("i", "block", "a", "b", "st", "size"))
        lists = own.column("s").combine_chunks()
        ends, values = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), lists.flatten().to_numpy()
        sizes, group = np.diff(ends), np.repeat(np.arange(len(groups) - 1), np.diff(groups))
        pairs = []
        cuts = groups[_pieces(np.diff(groups), BLOCK)]
        for x, y in zip(cuts, cuts[1:]):
            words, spot = np.unique(values[ends[x] : ends[y]], return_inverse=True)
            held = np.zeros((y - x, max(1, len(words))), "f4")
            held[np.repeat(np.arange(y - x), sizes[x:y]), spot] = 1
            left, right = np.flatnonzero(block[x:y] == a[x:y]), np.flatnonzero(block[x:y] == b[x:y])
            shared = held[left] @ held[right].T
            u, v = left + x, right + x
            apart = i[v][None, :] - i[u][:, None]
            u_at, v_at = np.nonzero((shared > 0) & (group[u][:, None] == group[v][None, :]) & (apart > 0) & (apart <= (band or np.iinfo("i8").max)))
            u, v = u[u_at], v[v_at]
            ident = np.power(shared[u_at, v_at].astype("f8") / np.minimum(sizes[u], sizes[v]), 1 / k) * 100
            high = ident > least
            pairs.append((u[high], v[high], ident[high]))
        u, v, ident = (np.concatenate(x) for x in zip(*pairs))
        columns = [own.column("region_id").take(pa.array(u)).combine_chunks(), *(pa.array(c) for c in (i[u], i[v], st[u], st[u] + size[u], st[v], st[v] + size[v], ident))]
        return pa.RecordBatch.from_arrays(columns, names)

    def stream(batches):
        rest = None
        for batch in batches:
            own = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            if not own.num_rows:
                continue
            region = own.column("region_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            keys = np.stack([region, own.column("a").to_numpy(), own.column("b").to_numpy()])
            begins = np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))])
            if len(begins) > 1:
                yield meet(own.slice(0, begins[-1]), begins)
            rest = own.slice(begins[-1])  # the last group may go on
        if rest is not None:
            yield meet(rest, np.array([0, rest.num_rows]))

    group = ["region_id", "a", "b"]
    return rows.repartition(*group).sortWithinPartitions(*group, "i").mapInArrow(stream, out)


def group_identity(pairs: DataFrame, min_ident: float) -> DataFrame:
    """Rows (region_id, st, end, ident): runs of neighbouring windows that repeat, with the mean of what each shares with its likest window.

    A window repeats if it is above the identity with another one.  It goes on with the next one if the two are alike, or alike to windows that
    follow each other too, in the same order (the same distance on) or reversed (the same sum of places)."""
    high = pairs.filter(F.col("ident") > min_ident)
    ways = high.select("region_id", "i", "j", "st", "end", "ident").unionByName(high.select("region_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("other_st").alias("st"), F.col("other_end").alias("end"), "ident"))
    ways = ways.withColumns({"ahead": F.col("j") - F.col("i"), "sum": F.col("i") + F.col("j")})
    follows = lambda key: F.coalesce(F.lag("i").over(Window.partitionBy("region_id", key).orderBy("i")) == F.col("i") - 1, F.lit(False))
    ways = ways.withColumn("goes_on", follows("ahead") | follows("sum") | (F.col("ahead") == -1))
    own = ways.groupBy("region_id", "i").agg(F.min("st").alias("st"), F.max("end").alias("end"), F.max("ident").alias("ident"), F.max("goes_on").alias("goes_on"))
    w = Window.partitionBy("region_id").orderBy("i")
    runs = own.withColumn("__run", F.sum((~F.col("goes_on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("region_id", "__run").agg(F.min("st").alias("st"), F.max("end").alias("end"), F.avg("ident").alias("ident")).drop("__run")


def number_groups(groups: DataFrame, min_size: int, min_ident: float) -> DataFrame:
    """Groups longer than min_size and above min_ident (both strictly), numbered from 1 in order."""
    w = Window.partitionBy("region_id").orderBy("st")
    return groups.filter((F.col("end") - F.col("st") > min_size) & (F.col("ident") > min_ident)).select("region_id", F.row_number().over(w).cast("long").alias("bin"), "st", "end")


def median_cov(frame: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (region_id, st, end, median): median coverage in each closed range, cut off; 0 without rows."""
    ranges = ranges.select("region_id", "st", "end").distinct()
    points = frame.select("region_id", "pos", "cov").withColumn("__pos", F.col("pos"))
    met = range_join(points, ranges.select("region_id", "st", "end"), ["region_id"], ("pos", "__pos"), ("st", "end"))
    got = met.groupBy("region_id", "st", "end").agg(F.floor(F.median("cov")).cast("long").alias("median"))
    return ranges.join(got, ["region_id", "st", "end"], "left").withColumn("median", F.coalesce("median", F.lit(0)))


def close_gaps(frame: DataFrame, bins: DataFrame, min_size: int) -> DataFrame:
    """Gaps of at most min_size between neighbouring bins go to the one whose median coverage is nearer the gap's; ties to the right.

    A start that moves counts in the next pair: it then is the end of the bin before.  So a pair needs the medians of
    the gap, of either bin and of the left bin from the end before it on, all made in one distributed pass;
    only the bins themselves (few in a region) meet in one group.
    """
    w = Window.partitionBy("region_id").orderBy("st", "bin")
    rows = bins.select("region_id", "bin", F.col("st").cast("long").alias("st"), F.col("end").cast("long").alias("end")).withColumns({"b_end": F.lag("end").over(w), "n_st": F.lead("st").over(w), "nth": F.row_number().over(w)})
    kinds = {"own": ("st", "end"), "longer": ("b_end", "end"), "gap": ("end", "n_st")}
    ranges = rows.select("region_id", F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in kinds.values()])).alias("r")).select("region_id", F.col("r.a").alias("st"), F.col("r.b").alias("end")).filter("st is not null and end is not null")
    medians = written(median_cov(frame, ranges), "gap-medians")
    for k, (a, b) in kinds.items():
        named = medians.select(F.col("region_id").alias("__id"), F.col("st").alias("__a"), F.col("end").alias("__b"), F.col("median").alias(k))
        rows = rows.join(named, (F.col("region_id") == F.col("__id")) & (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")), "left").drop("__id", "__a", "__b")

    def close(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("nth")
        st, end, moved = own["st"].tolist(), own["end"].tolist(), False
        for k in range(len(own) - 1):
            left, right, now = own.iloc[k], own.iloc[k + 1], moved
            moved = False
            if right["st"] - left["end"] <= min_size:
                at_left = left["longer"] if now else left["own"]
                if abs(at_left - left["gap"]) < abs(right["own"] - left["gap"]):
                    end[k] = st[k + 1]
                else:
                    st[k + 1], moved = end[k], True
        return own.assign(st=st, end=end)[["region_id", "bin", "st", "end"]]

    kind = dict(bins.dtypes)["region_id"]
    return rows.groupBy("region_id").applyInPandas(close, f"region_id {kind}, bin long, st long, end long")


def assign_bins(frame: DataFrame, bins: DataFrame) -> DataFrame:
    """``frame`` with ``bin``: the greatest bin whose [st - 1, end] holds the position, else 0.

    Bins are spread over pieces of the axis; a position meets the list of its piece's bins.
    """
    low, high = F.col("st") - 1, F.col("end")
    own = bins.select("region_id", F.struct(F.col("bin").alias("bin"), low.alias("st"), high.alias("end")).alias("b"), F.explode(F.sequence(F.floor(low / BUCKET), F.floor(F.greatest(low, high) / BUCKET))).alias("__piece"))
    lists = own.groupBy("region_id", "__piece").agg(F.collect_list("b").alias("__bins"))
    met = frame.drop("bin").withColumn("__piece", F.floor(F.col("pos") / BUCKET)).join(lists, ["region_id", "__piece"], "left")
    hit = F.transform("__bins", lambda b: F.when((F.col("pos") >= b["st"]) & (F.col("pos") <= b["end"]), b["bin"]))
    return met.withColumn("bin", F.coalesce(F.array_max(hit), F.lit(0)).cast("long")).drop("__piece", "__bins")
