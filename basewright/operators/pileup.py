"""Per-base pileup of alignments over regions.

Reads are rows (chrom, start, cigar, mapq) with 1-based starts; regions are rows
(region_id, chrom, st, end), closed.  A read's CIGAR becomes a few blocks, which are
clipped to the region and to tiles of the axis.  Of a block only its two ends are counted, one
up and one behind its last base down, with map-side combining; a tile's bases follow from
running sums over its ends.  So a base costs one row however deep it is covered, and what
a task holds is bounded by the tile's length and the number of mapping qualities.

A null MAPQ counts as 0.  No read is filtered by flags.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import range_join

#: Bases that one task makes at a time.
TILE = 1 << 16
OPS = np.array(["C", "X", "D", "I", "S"])
BLOCKS = "array<struct<op:string,at:bigint,len:bigint>>"


def parse_cigars(cigars: list[str | None], starts: np.ndarray, min_ins: int, min_del: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of many alignments at once, in order: which alignment, kind (index into OPS), first position and length.

    C covers, X covers and mismatches, I and S are events at one position, D deletes without
    covering.  Insertions and deletions below the sizes leave no event; a small deletion counts as covered.
    """
    lengths = np.array([len(c or "") for c in cigars], "i8")
    chars = np.frombuffer("".join([c or "" for c in cigars]).encode("ascii", "replace"), "u1")
    digit = (chars >= 48) & (chars <= 57)
    at = np.flatnonzero(~digit)
    row_end = np.cumsum(lengths)
    row = np.searchsorted(row_end, at, "right")
    begun = np.maximum(np.concatenate([[0], at[:-1] + 1])[: len(at)], (row_end - lengths)[row]) if len(at) else at
    width = at - begun
    n = np.zeros(len(at), "i8")
    for d in range(int(width.max(initial=0))):
        wide = width > d
        n[wide] += (chars[at[wide] - 1 - d].astype("i8") - 48) * 10**d
    op = chars[at]
    is_op = {x: op == ord(x) for x in "MIDNSX="}
    advance = np.where(is_op["M"] | is_op["="] | is_op["X"] | is_op["D"] | is_op["N"], n, 0)
    before = np.cumsum(advance) - advance
    first = np.searchsorted(row, row, "left")
    place = starts[row] + before - before[first] if len(at) else before
    kind = np.full(len(at), -1)
    kind[is_op["M"] | is_op["="]] = 0
    kind[is_op["X"]] = 1
    kind[is_op["D"]] = np.where(n[is_op["D"]] >= min_del, 2, 0)
    kind[is_op["I"] & (n >= min_ins)] = 3
    kind[is_op["S"]] = 4
    event = kind >= 3
    n = np.where(event, 1, n)
    keep = (kind >= 0) & (n > 0) & (width > 0)
    return row[keep], kind[keep], place[keep], n[keep]


def cigar_blocks(reads: DataFrame, min_ins: int = 2, min_del: int = 2) -> DataFrame:
    """Rows (chrom, r_st, r_end, mapq, blocks): each read with its blocks and the last position they touch; reads without any are left out.

    One Arrow pass over the reads.
    """

    def run(batches):
        for b in batches:
            row, kind, at, n = parse_cigars(b.column(2).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), min_ins, min_del)
            if not len(row):
                continue
            own, first = np.unique(row, return_index=True)
            blocks = pa.StructArray.from_arrays([pa.array(OPS[kind]), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["op", "at", "len"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), blocks)
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.maximum.reduceat(at + n - 1, first), pa.int64()), b.column(3).take(take), lists], names=["chrom", "r_st", "r_end", "mapq", "blocks"])

    rows = reads.filter(F.col("start").isNotNull() & F.col("cigar").isNotNull()).select("chrom", F.col("start").cast("long").alias("r_st"), "cigar", F.coalesce(F.col("mapq").cast("int"), F.lit(0)).alias("mapq"))
    return rows.mapInArrow(run, f"chrom string, r_st long, r_end long, mapq int, blocks {BLOCKS}")


def region_blocks(reads: DataFrame, regions: DataFrame, min_ins: int = 2, min_del: int = 2) -> DataFrame:
    """Rows (region_id, op, b_st, b_end, mapq): blocks of the reads that overlap a region, clipped to it."""
    parsed = cigar_blocks(reads, min_ins, min_del)
    met = range_join(parsed, regions.select("region_id", "chrom", "st", "end"), ["chrom"], ("r_st", "r_end"), ("st", "end"))
    each = met.select("region_id", "st", "end", "mapq", F.explode("blocks").alias("b"))
    clipped = each.select("region_id", F.col("b.op").alias("op"), F.greatest("b.at", "st").alias("b_st"), F.least(F.col("b.at") + F.col("b.len") - 1, F.col("end")).alias("b_end"), "mapq")
    return clipped.filter("b_st <= b_end")


def block_ends(blocks: DataFrame) -> DataFrame:
    """Rows (region_id, tile, pos, mapq, cov, mismatch, indel, softclip): by how much the numbers of blocks change at a position of a tile."""
    tiled = blocks.withColumn("tile", F.explode(F.sequence(F.floor(F.col("b_st") / TILE), F.floor(F.col("b_end") / TILE))))
    ends = F.explode(F.array(F.struct(F.greatest(F.col("b_st"), F.col("tile") * TILE).alias("pos"), F.lit(1).alias("n")), F.struct((F.least(F.col("b_end"), (F.col("tile") + 1) * TILE - 1) + 1).alias("pos"), F.lit(-1).alias("n"))))
    each = tiled.select("region_id", "tile", "op", "mapq", ends.alias("e")).select("region_id", "tile", "op", "mapq", "e.pos", "e.n")
    covers = F.col("op").isin("C", "X")
    of = lambda *ops: F.sum(F.when(F.col("op").isin(*ops), F.col("n")).otherwise(0))
    mapq = F.when(covers, F.col("mapq")).otherwise(0).alias("mapq")
    return each.groupBy("region_id", "tile", "pos", mapq).agg(of("C", "X").alias("cov"), of("X").alias("mismatch"), of("I", "D").alias("indel"), of("S").alias("softclip"))


def tile_signals(st: int, n: int, pos: np.ndarray, mapq: np.ndarray, changes: dict[str, np.ndarray], median: bool) -> dict[str, np.ndarray]:
    """The signals at n positions from st on, from the changes at some of them; what is behind the last position doesn't matter."""
    at = np.minimum(pos - st, n)
    total = lambda x, own=slice(None): np.cumsum(np.bincount(at[own], x[own], n + 1))[:n].astype("i8")
    out = {x: total(changes[x]) for x in ("cov", "mismatch", "indel", "softclip")}
    cov, most, sums, below = out["cov"], np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n, "i8")
    low, high = np.zeros(n, "i8"), np.zeros(n, "i8")
    for q in np.unique(mapq[changes["cov"] != 0]).tolist():
        own = total(changes["cov"], mapq == q)
        most[own > 0] = q
        if median:
            new = below + own
            # the two middle ones are those with (cov - 1) // 2 and cov // 2 before them
            low[(below <= (cov - 1) // 2) & ((cov - 1) // 2 < new)] = q
            high[(below <= cov // 2) & (cov // 2 < new)] = q
            below = new
        else:
            sums += q * own
    if median:
        mean = (low + high + 1) // 2
    else:
        mean = np.where(cov > 0, (sums + cov - 1) // np.maximum(cov, 1), 0)
    return out | {"mapq_max": most, "mapq": np.where(cov > 0, mean, 0)}


def pileup(reads: DataFrame, regions: DataFrame, min_ins: int = 2, min_del: int = 2, mapq_agg: str = "Mean") -> DataFrame:
    """Rows (region_id, chrom, pos, cov, mismatch, mapq_max, mapq, indel, softclip), one for every position of every region.

    MAPQ is the mean or median of the reads that cover a base, rounded up; 0 without reads.
    """
    if mapq_agg not in ("Mean", "Median"):
        raise ValueError("mapq_agg must be Mean or Median")
    median, kind = mapq_agg == "Median", dict(regions.dtypes)["region_id"]
    tiles = regions.select("region_id", "chrom", F.col("st").cast("long").alias("st"), F.col("end").cast("long").alias("end")).withColumn("tile", F.explode(F.sequence(F.floor(F.col("st") / TILE), F.floor(F.col("end") / TILE))))
    tiles = tiles.select("region_id", "chrom", "tile", F.greatest("st", F.col("tile") * TILE).alias("st"), F.least("end", (F.col("tile") + 1) * TILE - 1).alias("end"))
    ends = block_ends(region_blocks(reads, regions, min_ins, min_del))

    def dense(own: pa.Table, changes: pa.Table) -> pa.Table:
        parts = []
        number = lambda c: changes.column(c).to_numpy().astype("i8")
        for k in range(own.num_rows):  # one row, unless a region is given twice
            st, n = own.column("st")[k].as_py(), own.column("end")[k].as_py() - own.column("st")[k].as_py() + 1
            made = tile_signals(st, n, number("pos"), number("mapq"), {x: number(x).astype("f8") for x in ("cov", "mismatch", "indel", "softclip")}, median)
            same = pa.array(np.full(n, k))
            columns = [own.column("region_id").take(same), own.column("chrom").take(same), pa.array(np.arange(st, st + n))]
            parts.append(pa.table(columns + [pa.array(made[x], pa.int32() if x in ("mapq", "mapq_max") else pa.int64()) for x in NAMES[3:]], names=NAMES))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (pa.string(), pa.string(), *[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.int64()] * 2)], names=NAMES)

    schema = f"region_id {kind}, chrom string, pos long, cov long, mismatch long, mapq_max int, mapq int, indel long, softclip long"
    ends = ends.withColumnsRenamed({"region_id": "e_region", "tile": "e_tile"})
    return tiles.groupBy("region_id", "tile").cogroup(ends.groupBy("e_region", "e_tile")).applyInArrow(dense, schema)


def relabel_zero(frame: DataFrame, regions: DataFrame, compat: bool = False) -> DataFrame:
    """A pileup without the position 0 of regions that start there, as bases count from 1.

    ``compat``: such a region's labels are one less than the positions instead, so that position 0, which has no reads, becomes the last label.
    """
    if not compat:
        return frame.filter("pos > 0")
    first = regions.filter("st = 0").select("region_id", (F.col("end") + 1).cast("long").alias("__n"))
    shifted = F.when(F.col("__n").isNull(), F.col("pos")).otherwise(F.pmod(F.col("pos") - 1, F.col("__n")))
    return frame.join(first, "region_id", "left").withColumn("pos", shifted).select(frame.columns)


NAMES = ["region_id", "chrom", "pos", "cov", "mismatch", "mapq_max", "mapq", "indel", "softclip"]


def rolling_mean(frame: DataFrame, windows: dict[str, int | None], part: list[str] | None = None, dense: bool = False) -> DataFrame:
    """Centred rolling means, shorter at the ends; an even window has one more row before than after.

    ``dense``: the frame has every position of a part once, as a pileup has.  Then a window's rows are known
    by their positions, and tiles with copies of their neighbours' nearest rows are windows of their own.
    """
    part, wanted = part or ["region_id"], {c: n for c, n in windows.items() if n}
    if not wanted:
        return frame
    mean = lambda w: {c: F.avg(c).over(w.rowsBetween(-(n // 2), (n - 1) // 2)) for c, n in wanted.items()}
    if not dense:
        return frame.withColumns(mean(Window.partitionBy(*part).orderBy("pos")))
    reach, own = max(wanted.values()), F.floor(F.col("pos") / TILE)
    copies = frame.withColumn("__tile", F.explode(F.sequence(F.floor((F.col("pos") - reach) / TILE), F.floor((F.col("pos") + reach) / TILE))))
    return copies.withColumns(mean(Window.partitionBy(*part, "__tile").orderBy("pos"))).filter(F.col("__tile") == own).drop("__tile")
