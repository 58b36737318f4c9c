"""The engine's entry points."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, read_config
from .operators import binning
from .operators.classify import above_runs, bin_stats, classify_bases, signals, status_intervals
from .operators.intervals import range_join, range_least
from .operators.merge import bed9, merge_misassemblies
from .operators.pileup import pileup, relabel_zero, rolling_mean
from .shared import written
from .sources.bam import bam_contigs, read_alignments
from .sources.bed import read_bed, read_ignored
from .sources.fasta import read_fai, read_fasta
from .sources.tiles import tiles


class Calls(NamedTuple):
    """BED9 rows and the pileup table, both keyed by region_id; from files also the regions that couldn't be called, with the reason."""

    regions: DataFrame
    pileup: DataFrame
    errors: DataFrame | None = None


#: With so many regions at most, only what overlaps them is read of an alignment file.
REGIONS_READ = 10_000


def regions(spark: SparkSession, contigs: DataFrame | None = None, bed: str | None = None, window: int = 10_000_000) -> DataFrame:
    """Rows (region_id, chrom, st, end): those of a BED file, else tiles of whole contigs.  A region given twice is called once."""
    found = read_bed(spark, bed) if bed else tiles(contigs, window)
    return found.select(F.xxhash64("chrom", "st", "end").alias("region_id"), "chrom", "st", "end").distinct()


def region_errors(found: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Regions that can't be called, with the reason; ``call_regions`` leaves them out.  ``contigs``: (chrom, length) of the alignments."""
    why = F.when(F.col("chrom").isNull() | F.col("st").isNull() | F.col("end").isNull(), "a field is missing").when(F.col("st") < 0, "negative start").when(F.col("end") < F.col("st"), "end before start")
    if contigs is not None:
        found = found.join(contigs.select("chrom", F.lit(True).alias("__known")), "chrom", "left")
        why = F.coalesce(why, F.when(F.col("__known").isNull(), "unknown contig"))
        return found.withColumn("error", why).filter("error is not null").select("region_id", "chrom", "st", "end", "error")
    return found.withColumn("error", why).filter("error is not null")


def broken_regions(found: DataFrame, broken: DataFrame) -> DataFrame:
    """Regions that overlap parts of the alignment file that can't be read, with the reason.  ``broken``: (chrom, start, until, error);
    a part without a contig's name may hold reads of any."""
    parts = broken.select("chrom", F.col("start").cast("long").alias("b_st"), F.col("until").alias("b_end"), "error")
    # the reason depends on the range alone; regions and parts never meet in pairs
    met = found.join(range_least(found, parts.filter("chrom <> ''"), ["chrom"], ("st", "end"), ("b_st", "b_end"), "error"), ["chrom", "st", "end"])
    anywhere = parts.filter("chrom = ''").agg(F.min("error").alias("error")).filter("error is not null")  # one row
    met = met.select("region_id", "chrom", "st", "end", "error").unionByName(found.join(F.broadcast(anywhere)).select("region_id", "chrom", "st", "end", "error"))
    return met.groupBy("region_id", "chrom", "st", "end").agg(F.min("error").alias("error"))


def classified_pileup(reads: DataFrame, found: DataFrame, cfg: Config, bins: DataFrame | None = None) -> DataFrame:
    """The pileup with bins, peaks of every signal and a status for each base."""
    found = found.filter("st >= 0 and end >= st and chrom is not null")
    frame = pileup(reads, found, cfg.indel.min_ins_size, cfg.indel.min_del_size, cfg.mapq.mapq_agg_fn)
    frame = relabel_zero(frame, found, cfg.compat_zero_start)
    frame = rolling_mean(frame, {"cov": cfg.cov.rolling_mean_window, "mismatch": cfg.mismatch.rolling_mean_window, "indel": cfg.indel.rolling_mean_window}, dense=True)
    frame = binning.assign_bins(frame, bins) if bins is not None else frame.withColumn("bin", F.lit(0).cast("long"))
    # read by the statistics and by the bases they are joined to; the step from blocks to bases so runs once
    return classify_bases(signals(written(frame, "bases"), cfg), cfg)


def identity_bins(reads: DataFrame, found: DataFrame, chunks: DataFrame, cfg: Config) -> DataFrame:
    """Bins (region_id, bin, st, end) of self-identical sequence.  ``chunks``: (chrom, start, seq) of window_size bases each."""
    g = cfg.group_by_ani
    own = found.filter(F.col("end") - F.col("st") > g.window_size)
    begun = chunks.select("chrom", F.col("start").cast("long").alias("c_st"), F.col("start").cast("long").alias("c_end"), "seq")
    windows = range_join(begun, own, ["chrom"], ("c_st", "c_end"), ("st", "end")).select("region_id", F.col("c_st").alias("st"), "seq")
    bins = binning.number_groups(binning.group_identity(binning.self_identity(windows, g.window_size, g.min_ident), g.min_ident), g.min_grp_size, g.min_ident)
    frame = pileup(reads, own, cfg.indel.min_ins_size, cfg.indel.min_del_size, cfg.mapq.mapq_agg_fn)
    return binning.close_gaps(frame, bins, g.min_grp_size)


def call_regions(reads: DataFrame, found: DataFrame, cfg: Config | None = None, ignore: DataFrame | None = None, chunks: DataFrame | None = None, lengths: DataFrame | None = None, bins: DataFrame | None = None) -> Calls:
    """Calls misassemblies in all regions in one job.

    reads: (chrom, start, cigar, mapq); found: (region_id, chrom, st, end); ignore: (chrom, st, end);
    chunks: sequence as (chrom, start, seq); lengths: (chrom, length); bins: (region_id, bin, st, end),
    taken instead of bins from the sequence.  The table of bases and the intervals are written to the folder in
    ``spark.checkpoint.dir``, where the caller may delete them after use.
    """
    cfg = cfg or Config()
    if bins is None and chunks is not None and cfg.group_by_ani is not None:
        bins = written(identity_bins(reads, found, chunks, cfg), "identity-bins")
    frame = written(classified_pileup(reads, found, cfg, bins), "pileup")  # read by the statistics, the runs, the intervals and the caller
    stats = written(bin_stats(frame, cfg.general.bp_merge), "bin-stats")
    above = above_runs(frame.join(stats.select("region_id", "bin", "median"), ["region_id", "bin"]), "median")
    chroms = found.select("region_id", "chrom")
    itvs = status_intervals(frame).join(chroms, "region_id")
    final = merge_misassemblies(itvs, stats, above, cfg, ignore, chunks, lengths)
    table = frame.select("region_id", "chrom", "pos", "cov", "status", "mismatch", "mapq", "indel", "softclip", "bin")
    return Calls(bed9(final), table)


def call_file(spark: SparkSession, aln: str, fasta: str | None = None, bed: str | None = None, ignore_bed: str | None = None, cfg: str | None = None, preset: str | None = None, found: DataFrame | None = None) -> Calls:
    """Calls the regions of a BED file, or whole contigs in tiles, on an alignment file.  A region that can't be called is left out and
    named in ``errors``.  ``cfg``, ``preset``: a configuration file and a preset over it; ``found``: regions instead of a BED file."""
    conf = read_config(cfg, preset)
    contigs = bam_contigs(spark, aln)
    if found is None:
        found = regions(spark, contigs, bed, conf.general.bp_wg_window)
    errors = region_errors(found, contigs)
    good = found.join(errors.select("region_id"), "region_id", "left_anti")
    some = good.select("chrom", "st", "end").limit(REGIONS_READ + 1).collect()
    # one pass over the file, whose parts that can't be read become rows of their own
    rows = written(read_alignments(spark, aln, [tuple(r) for r in some] if len(some) <= REGIONS_READ else None, errors=True), "reads")
    broken = written(broken_regions(good, rows.filter("error is not null")), "broken-regions")
    good, errors = good.join(broken.select("region_id"), "region_id", "left_anti"), errors.unionByName(broken)
    reads = rows.filter("error is null").select("chrom", "start", "cigar", "mapq")
    chunks = read_fasta(spark, fasta) if fasta else None
    lengths = read_fai(spark, fasta + ".fai").select("chrom", "length") if fasta else None
    called = call_regions(reads, good, conf, read_ignored(spark, ignore_bed), chunks, lengths)
    return Calls(called.regions, called.pileup, errors)


def call_region(spark: SparkSession, aln: str, region: tuple[int, int, str], fasta: str | None = None, ignore_bed: str | None = None, cfg: str | None = None, preset: str | None = None) -> Calls:
    """Calls one region (st, end, chrom); raises where that can't be done."""
    st, end, chrom = region
    found = spark.createDataFrame([(0, chrom, st, end)], "region_id long, chrom string, st long, end long")
    if bad := region_errors(found, bam_contigs(spark, aln)).collect():
        raise ValueError(f"{chrom}:{st}-{end}: {bad[0]['error']}")
    calls = call_file(spark, aln, fasta, ignore_bed=ignore_bed, cfg=cfg, preset=preset, found=found)
    if bad := calls.errors.collect():
        raise ValueError(f"{chrom}:{st}-{end}: {bad[0]['error']}")
    return calls
