"""From status intervals to final calls."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.status import COLOURS, GOOD, MERGEABLE, colour, image, known, over, stronger, stronger_of
from ..shared import written
from .intervals import ADD, MOST, Fold, island, merge_intervals, overlap_length, range_join, subtract
from .repeats import with_largest_repeat

REGION = ["region_id"]


#: Steps after which a fold of half means depends on the value from the left by one at most, as coverages are below 2 ** STEPS.
STEPS = 31


def _half_mean_then(f: Column, b: Column) -> Column:
    """x -> (x + s) >> k with one more step; from STEPS steps on x -> s + (x >= t), or s where t is null."""
    made = lambda k, s, t: F.struct(k.cast("int").alias("k"), s.cast("long").alias("s"), t.cast("long").alias("t"))
    more, never = f["s"] + F.call_function("shiftleft", b.cast("long"), f["k"]), F.lit(None)
    at_last = made(F.lit(STEPS), F.shiftright(more, STEPS), F.lit(1 << STEPS) - more.bitwiseAND(F.lit((1 << STEPS) - 1)))
    odd = (f["s"] + b).bitwiseAND(F.lit(1)) == 1
    beyond = made(f["k"], F.shiftright(f["s"] + b, 1), F.when(odd, f["t"]))
    return F.when(f["k"] < STEPS - 1, made(f["k"] + 1, more, never)).when(f["k"] == STEPS - 1, at_last).otherwise(beyond)


#: Mean of two whole numbers, cut off: folded pair by pair from the left, as the coverage of merged intervals is.
HALF_MEAN = Fold(
    lambda a, b: F.floor((a + b) / 2).cast("long"),
    lambda: F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("s"), F.lit(None).cast("long").alias("t")),
    _half_mean_then,
    lambda f, x: F.when(f["k"] < STEPS, F.call_function("shiftright", x.cast("long") + f["s"], f["k"])).otherwise(f["s"] + F.coalesce(x >= f["t"], F.lit(False)).cast("long")),
)
STRONGEST = Fold(stronger, lambda: F.array(*map(F.lit, COLOURS)), stronger_of, image)


def merge_bad(itvs: DataFrame, bp_merge: int) -> DataFrame:
    """Non-good intervals joined over gaps of at most bp_merge, with the strongest status."""
    bad = itvs.filter(F.col("status") != GOOD).select(*REGION, "st", "end", "ord", "status", "cov")
    return merge_intervals(bad, REGION, bp_merge, fold={"status": STRONGEST, "cov": HALF_MEAN})


def reclassify(itvs: DataFrame, merged: DataFrame) -> DataFrame:
    """Each interval takes the status of a merged one that covers half of it or more, if that is stronger.

    Merged intervals are further apart than they can both cover half; should two tie, the first counts.
    """
    m = merged.select("region_id", F.col("st").alias("m_st"), F.col("end").alias("m_end"), F.col("status").alias("m_status"))
    met = range_join(itvs.select("region_id", "ord", "st", "end"), m, REGION, ("st", "end"), ("m_st", "m_end"))
    share = overlap_length(F.col("st"), F.col("end"), F.col("m_st"), F.col("m_end")) * 2 >= F.col("end") - F.col("st")
    best = met.filter(share).groupBy("region_id", "ord").agg(F.min_by("m_status", "m_st").alias("m_status"))
    out = itvs.join(best, ["region_id", "ord"], "left")
    taken = F.col("m_status").isNotNull() & over(F.col("m_status"), F.col("status"))
    return out.withColumn("own_status", F.col("status")).withColumn("status", F.when(taken, F.col("m_status")).otherwise(F.col("status"))).drop("m_status")


def check_repeats(itvs: DataFrame, chunks: DataFrame, cfg: Config) -> DataFrame:
    """Intervals of the checked types become scaffold, or homopolymer or repeat if that covers more than the ratio.

    ``chunks``: the sequence as rows (chrom, start 1-based, seq).  Only intervals of checked types read any; ends are clipped to the sequence.
    """
    r = cfg.repeat
    want = itvs.filter(F.col("own_status").isin(*r.check_types)).select("region_id", "ord", "chrom", F.greatest(F.col("st") - r.bp_extend, F.lit(1)).alias("q_st"), (F.col("end") + r.bp_extend).alias("q_end"))
    parts = range_join(want, chunks.select("chrom", F.col("start").alias("c_st"), (F.col("start") + F.length("seq") - 1).alias("c_end"), "seq"), ["chrom"], ("q_st", "q_end"), ("c_st", "c_end"))
    cut = parts.withColumn("at", F.greatest("q_st", "c_st")).withColumn("piece", F.col("seq").substr((F.greatest("q_st", "c_st") - F.col("c_st") + 1).cast("int"), (F.least("q_end", "c_end") - F.greatest("q_st", "c_st") + 1).cast("int")))
    seqs = cut.groupBy("region_id", "ord").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])).alias("seq"))
    found = with_largest_repeat(seqs, "seq").select("region_id", "ord", F.col("largest.repeat").alias("kind"), F.col("largest.prop").alias("prop"))
    out = itvs.join(found, ["region_id", "ord"], "left")
    taken = (F.col("kind") == "scaffold") | (F.col("kind").isNotNull() & (F.col("prop") > r.ratio_repeat))
    return out.withColumn("status", F.when(taken, F.col("kind")).otherwise(F.col("status"))).drop("kind", "prop")


def suppress_boundaries(itvs: DataFrame, stats: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Intervals at a contig's (or the region's) start and end turn good as long as their coverage is below their bin's median.

    ``ends``: (chrom, length) where contig lengths are known; then the start is 0 or 1 (a region from 0 begins with base 1, or
    with label 0) and the end length + 1.
    A bin without a median suppresses nothing.
    """
    w = Window.partitionBy("region_id")
    up, down = w.orderBy("st", "ord"), w.orderBy(F.col("st").desc(), F.col("ord").desc())
    rows = itvs.join(stats.select("region_id", "bin", F.floor("median").alias("__med")), ["region_id", "bin"], "left")
    if ends is not None:
        rows = rows.join(ends.select("chrom", F.col("length").alias("__length")), "chrom", "left")
    else:
        rows = rows.withColumn("__length", F.lit(None).cast("long"))
    low = F.min("st").over(w)
    high = F.max("end").over(w)
    rows = rows.withColumns({"__low": low, "__high": high, "__first_st": F.first("st").over(up), "__last_end": F.first("end").over(down)})
    stops = F.coalesce(F.col("cov") >= F.col("__med"), F.lit(True)).cast("int")
    rows = rows.withColumn("__stop", stops).withColumns({"__before": F.sum("__stop").over(up.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.sum("__stop").over(down.rowsBetween(Window.unboundedPreceding, 0))})
    at_start = F.when(F.col("__length").isNull(), F.col("__first_st") == F.col("__low")).otherwise(F.col("__first_st") <= 1)
    at_end = F.col("__last_end") == F.when(F.col("__length").isNull(), F.col("__high")).otherwise(F.col("__length") + 1)
    gone = at_start & (F.col("__before") == 0) | at_end & (F.col("__after") == 0)
    return rows.withColumn("status", F.when(gone, GOOD).otherwise(F.col("status"))).select(itvs.columns)


def merge_chunks(itvs: DataFrame, above: DataFrame) -> DataFrame:
    """Consecutive mergeable intervals of one bin become one with the strongest status; a collapse that
    touches an above-median run at its bin's edge is a transition and turns good."""
    rows = itvs.select("region_id", "chrom", "bin", "st", "end", "ord", "status", F.col("cov").cast("long").alias("cov"), F.col("status").isin(*MERGEABLE).alias("__m"), F.lit(1).cast("long").alias("__n"), F.col("end").cast("long").alias("__high"))
    same = lambda before: F.col("__m") & before("__m") & (F.col("bin") == before("bin"))
    out = merge_intervals(rows, REGION, None, same, {"status": STRONGEST, "cov": ADD, "__n": ADD, "__high": MOST})
    out = out.select("region_id", "chrom", "bin", "st", F.col("__high").alias("end"), "ord", "status", F.floor(F.col("cov") / F.col("__n")).cast("long").alias("cov"))
    edge = above.select("region_id", "bin", F.col("above_st").cast("long").alias("a_st"), F.col("above_end").cast("long").alias("a_end"))
    touched = range_join(out.filter("status = 'collapse'").select("region_id", "bin", "ord", "st", "end"), edge, ["region_id", "bin"], ("st", "end"), ("a_st", "a_end")).select("region_id", "ord").distinct().withColumn("__t", F.lit(True))
    return out.join(touched, ["region_id", "ord"], "left").withColumn("status", F.when((F.col("status") == "collapse") & F.col("__t"), GOOD).otherwise(F.col("status"))).drop("__t")


def drop_small(itvs: DataFrame, cfg: Config) -> DataFrame:
    """Touching intervals (gap of at most 1) of one status join; those shorter than their status' minimum turn good."""
    same = merge_intervals(itvs.select("region_id", "chrom", "st", "end", "ord", "status", "cov"), ["region_id", "chrom"], 1, lambda before: before("status") == F.col("status"), {"cov": HALF_MEAN})
    sizes = asdict(cfg.minimum_size)
    least = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (GOOD if k == "null" else k, v)]), F.col("status"))
    return same.withColumn("status", F.when(F.col("end") - F.col("st") < least, GOOD).otherwise(F.col("status")))


def collapse_runs(itvs: DataFrame) -> DataFrame:
    """Consecutive intervals of one status become one, with the median of their coverages."""
    w = Window.partitionBy("region_id").orderBy("st", "ord")
    rows = itvs.withColumn("__new", F.coalesce(F.col("status") != F.lag("status").over(w), F.lit(True))).withColumn("__run", island(REGION, ["st", "ord"], F.col("__new")))
    return rows.groupBy("region_id", "chrom", "__run").agg(F.min("st").alias("st"), F.max("end").alias("end"), F.first("status").alias("status"), F.median("cov").alias("cov")).drop("__run")


def merge_misassemblies(itvs: DataFrame, stats: DataFrame, above: DataFrame, cfg: Config, ignore: DataFrame | None = None, chunks: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """All merge steps in order, from status intervals (region_id, chrom, bin, st, end, cov, status) to final ones."""
    w = Window.partitionBy("region_id").orderBy("st", "end", "bin")
    rows = itvs.withColumn("status", known(F.col("status"))).withColumn("ord", F.row_number().over(w).cast("long"))
    # each step reads its input more than once; written, the few intervals are made once and plans stay small
    rows = written(rows, "status-intervals")
    rows = written(reclassify(rows, merge_bad(rows, cfg.general.bp_merge)), "reclassified")
    if chunks is not None and cfg.repeat is not None:
        rows = written(check_repeats(rows, chunks, cfg), "repeats-checked")
    rows = rows.drop("own_status")
    if ignore is not None:
        rows = written(subtract(rows, ignore, ["chrom"]), "subtracted")
    if cfg.general.ignore_boundaries:
        rows = written(suppress_boundaries(rows, stats, lengths), "suppressed")
    return collapse_runs(drop_small(merge_chunks(rows, above), cfg))


def bed9(itvs: DataFrame) -> DataFrame:
    """Rows of BED9: chrom, chromStart, chromEnd, name, score, strand, thickStart, thickEnd, itemRgb (and region_id)."""
    st, end = F.col("st").cast("int"), F.col("end").cast("int")
    return itvs.select("region_id", "chrom", st.alias("chromStart"), end.alias("chromEnd"), F.col("status").alias("name"), F.col("cov").cast("double").alias("score"), F.lit(".").alias("strand"), st.alias("thickStart"), end.alias("thickEnd"), colour(F.col("status")).alias("itemRgb"))
