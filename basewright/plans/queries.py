"""One query for each operator, over stand-ins from the driver's whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import api
from ..config import Config, General
from ..functions.status import colour, known
from ..operators import binning, classify, merge, peaks, pileup, repeats
from ..operators.intervals import merge_intervals, overlap_length, range_join, subtract
from ..shared import fresh
from ..sources.bed import parse_bed, write_tsv
from ..sources.fasta import read_fasta
from ..sources.files import join_parts
from ..sources.reads import read_reads, write_reads
from ..sources.tiles import tiles
from . import standins as s

CFG = Config(general=General(bp_merge=20))
LEVEL = 50


def cigar_blocks(spark, sf_dir):
    return pileup.region_blocks(s.reads(spark, sf_dir), s.regions(spark)).groupBy("region_id", "op", "b_st", "b_end", "mapq").agg(F.count("*").alias("n"))


def pileup_mapq_mean(spark, sf_dir):
    return pileup.pileup(s.reads(spark, sf_dir), s.regions(spark))


def pileup_mapq_median(spark, sf_dir):
    return pileup.pileup(s.reads(spark, sf_dir), s.regions(spark), mapq_agg="Median")


def rolling_mean_signal(spark, sf_dir):
    return pileup.rolling_mean(s.signal(spark, sf_dir).withColumn("even", F.col("cov")), {"cov": 11, "even": 4}).select("region_id", "pos", F.round("cov", 6).alias("cov"), F.round("even", 6).alias("even"))


def _peaks(spark, sf_dir, drop):
    out = peaks.find_peaks(s.signal(spark, sf_dir), {"cov": (1.5, 1.5, drop)}, ["region_id"])
    return out.select("region_id", "pos", "cov", F.round("cov_median", 6).alias("cov_median"), F.round("cov_stdev", 6).alias("cov_stdev"), F.round("cov_zscore", 6).alias("cov_zscore"), "cov_peak")


def peaks_keep_zero(spark, sf_dir):
    return _peaks(spark, sf_dir, False)


def peaks_drop_zero(spark, sf_dir):
    return _peaks(spark, sf_dir, True)


def _classified(spark, sf_dir):
    return api.classified_pileup(s.reads(spark, sf_dir), s.regions(spark), CFG, s.bins(spark))


def signals_joined(spark, sf_dir):
    peak = [f"{x}_peak" for x in ("cov", "mismatch", "indel", "softclip", "mapq")]
    return _classified(spark, sf_dir).select("region_id", "bin", "pos", "cov", "mismatch", "indel", "softclip", "mapq", "mapq_max", *peak)


def classify_bases(spark, sf_dir):
    return _classified(spark, sf_dir).select("chrom", "pos", "cov", "status", "mismatch", "mapq", "indel", "softclip", "bin")


def status_intervals(spark, sf_dir):
    return classify.status_intervals(_classified(spark, sf_dir))


def above_median_runs(spark, sf_dir):
    return classify.above_runs(s.signal(spark, sf_dir).withColumn("level", F.lit(LEVEL)), "level", ["region_id"])


def _good(spark, sf_dir):
    return s.signal(spark, sf_dir).withColumn("status", F.when(F.col("cov") % 3 == 0, "indel").otherwise("good"))


def rolling_median_stats(spark, sf_dir):
    return classify.rolling_stats(_good(spark, sf_dir), 50, ["region_id"]).select("region_id", "pos", F.round("roll_median", 6).alias("roll_median"), F.round("roll_stdev", 6).alias("roll_stdev"))


def bin_stats(spark, sf_dir):
    return classify.bin_stats(_good(spark, sf_dir), 50, ["region_id"]).select("region_id", F.round("median", 6).alias("median"), F.round("stdev", 6).alias("stdev"))


def merge_intervals_distance(spark, sf_dir):
    rows = s.intervals(spark, sf_dir).select("region_id", "st", "end", "ord", "cov")
    return merge_intervals(rows, ["region_id"], 3, fold={"cov": merge.HALF_MEAN})


def merge_intervals_status(spark, sf_dir):
    rows = s.intervals(spark, sf_dir).select("region_id", "st", "end", "ord", "status", "cov")
    return merge_intervals(rows, ["region_id"], 1, lambda before: before("status") == F.col("status"), {"cov": merge.HALF_MEAN})


def merge_bad(spark, sf_dir):
    return merge.merge_bad(s.intervals(spark, sf_dir), 2)


def overlap_length_join(spark, sf_dir):
    a = s.intervals(spark, sf_dir).select("ord", "chrom", "st", "end")
    b = s.ignored(spark, sf_dir).toDF("chrom", "b_st", "b_end")
    return range_join(a, b, ["chrom"], ("st", "end"), ("b_st", "b_end"), bucket=256).select("ord", "b_st", overlap_length(F.col("st"), F.col("end"), F.col("b_st"), F.col("b_end")).alias("length"))


def overlap_semi_join(spark, sf_dir):
    b = s.ignored(spark, sf_dir).toDF("chrom", "b_st", "b_end")
    return range_join(s.intervals(spark, sf_dir), b, ["chrom"], ("st", "end"), ("b_st", "b_end"), "left_semi").select("ord", "chrom", "st", "end")


def overlap_majority(spark, sf_dir):
    itvs = s.intervals(spark, sf_dir)
    return merge.reclassify(itvs, merge.merge_bad(itvs, 2)).select("region_id", "ord", "st", "end", "status", "own_status")


def subtract_ignored(spark, sf_dir):
    return subtract(s.intervals(spark, sf_dir), s.ignored(spark, sf_dir), ["chrom"]).select("ord", "chrom", "st", "end", "status")


def boundary_suppress(spark, sf_dir):
    itvs = s.intervals(spark, sf_dir)
    stats = itvs.select("region_id", "bin").distinct().withColumn("median", F.lit(200.5))
    return merge.suppress_boundaries(itvs, stats).select("ord", "region_id", "st", "end", "status")


def mergeable_chunks(spark, sf_dir):
    itvs = s.intervals(spark, sf_dir)
    level = itvs.groupBy("region_id", "bin").agg(F.median("cov").alias("level"))
    above = itvs.join(level, ["region_id", "bin"]).filter("cov > 2 * level").select("region_id", "bin", F.col("st").alias("above_st"), F.col("end").alias("above_end"))
    return merge.merge_chunks(itvs, above).select("region_id", "bin", "st", "end", "ord", "status", "cov")


def min_size_filter(spark, sf_dir):
    itvs = s.intervals(spark, sf_dir)
    return merge.drop_small(itvs, CFG).select("region_id", "chrom", "st", "end", "ord", "status", "cov")


def final_collapse(spark, sf_dir):
    return merge.collapse_runs(s.intervals(spark, sf_dir))


def bed9_projection(spark, sf_dir):
    return merge.bed9(s.intervals(spark, sf_dir)).drop("region_id")


def status_colours(spark, sf_dir):
    return s.intervals(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).withColumn("rgb", colour(F.col("status")))


def bad_bases(spark, sf_dir):
    return _classified(spark, sf_dir).filter("status <> 'good'").groupBy("region_id", "bin", "status").agg(F.count("*").alias("n"))


def whole_genome_tiles(spark, sf_dir):
    contigs = s.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("chrom"), (F.col("s_suppkey") * 997 % 5000).alias("length"))
    return tiles(contigs, 500)


def bed_lines(spark, sf_dir):
    value = F.concat_ws("\t", F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("x")).otherwise(F.col("o_orderkey").cast("string")), (F.col("o_orderkey") + 5).cast("string"), F.col("o_orderpriority"), F.lit("more"))
    return parse_bed(s.table(spark, sf_dir, "orders").select(value.alias("value")))


def largest_repeat(spark, sf_dir):
    words = s.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("seq"))
    found = repeats.with_largest_repeat(words, "seq")
    return found.select("p_partkey", F.col("largest.repeat").alias("repeat"), F.col("largest.sequence").alias("sequence"), F.round("largest.prop", 6).alias("prop"))


def _bins(spark, sf_dir):
    return s.signal(spark, sf_dir).groupBy("region_id").agg(F.max("pos").alias("n")).select("region_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("bin"), "n").select("region_id", F.col("bin").cast("long").alias("bin"), F.floor(F.col("n") * F.col("bin") / 10).alias("st"), F.floor(F.col("n") * F.col("bin") / 10 + F.col("n") / 15).alias("end"))


def bin_assign(spark, sf_dir):
    return binning.assign_bins(s.signal(spark, sf_dir), _bins(spark, sf_dir)).select("region_id", "pos", "cov", "bin")


def range_medians(spark, sf_dir):
    return binning.median_cov(s.signal(spark, sf_dir), _bins(spark, sf_dir).drop("bin"))


def gap_close(spark, sf_dir):
    return binning.close_gaps(s.signal(spark, sf_dir), _bins(spark, sf_dir), 10**9)


def region_calls(spark, sf_dir):
    return api.call_regions(s.reads(spark, sf_dir), s.regions(spark), CFG, ignore=s.ignored(spark, sf_dir), bins=s.bins(spark)).regions


def self_identity(spark, sf_dir):
    """Pairs of windows of 60 letters of each document, of whose letters A, C, G and T are kept."""
    seq = F.upper(F.regexp_replace("text", "[^ACGTacgt]+", ""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = docs.select(F.col("doc_id").alias("region_id"), F.posexplode(F.regexp_extract_all(seq, F.lit("[ACGT]{1,60}"), F.lit(0))).alias("n", "seq"))
    windows = cut.select("region_id", (F.col("n") * 60 + 1).alias("st"), "seq")
    pairs = binning.self_identity(windows, 60, least=60.0, band=100, k=7, sketch=1)
    return pairs.select("region_id", "i", "j", "st", "end", "other_st", "other_end", F.round("ident", 4).alias("ident"))


def peaks_single(spark, sf_dir):
    """Peaks in 32-bit floats."""
    out = peaks.find_peaks(s.signal(spark, sf_dir), {"cov": (1.5, 1.5, True)}, ["region_id"], single=True)
    shown = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return out.select("region_id", "pos", "cov", shown("cov_median"), shown("cov_stdev"), shown("cov_zscore"), "cov_peak")


def above_runs_by_user(spark, sf_dir):
    """Runs at or above a user's median value that hold the user's first or last event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frame = s.table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).cast("long").alias("pos"), F.floor("value").cast("long").alias("cov"))
    level = frame.groupBy("user_id").agg(F.floor(F.median("cov")).alias("level"))
    return classify.above_runs(frame.join(level, "user_id"), "level", ["user_id"])


def boundary_contigs(spark, sf_dir):
    """Boundaries where contigs' lengths are known: even regions begin at 0, and one region of each contig ends with it."""
    itvs = s.intervals(spark, sf_dir)
    low = itvs.groupBy("region_id").agg(F.min("st").alias("low"))
    moved = itvs.join(low, "region_id").withColumn("low", F.when(F.col("region_id") % 2 == 0, F.col("low")).otherwise(-7))
    moved = moved.withColumns({"st": F.col("st") - F.col("low"), "end": F.col("end") - F.col("low")}).drop("low")
    ends = moved.groupBy("chrom").agg((F.max("end") - 1).alias("length"))
    stats = itvs.select("region_id", "bin").distinct().withColumn("median", F.lit(200.5))
    return merge.suppress_boundaries(moved, stats, ends).select("ord", "region_id", "st", "end", "status")


def known_statuses(spark, sf_dir):
    """Names of statuses as they are read from files: what isn't the name of a misassembly is good."""
    key, names = F.col("o_orderkey"), [*s.STATUSES, "scaffold", "homopolymer", "repeat", "null", "Indel"]
    name = F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), (key % 13 + 1).cast("int")), F.col("o_orderpriority"))
    return s.table(spark, sf_dir, "orders").select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n")).withColumn("status", known(F.col("name")))


def repeat_kinds(spark, sf_dir):
    name = F.coalesce(F.try_element_at(F.array(*map(F.lit, ("Scaffold", "HOMOPOLYMER", "repeat"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_type"))
    return s.table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("kind", repeats.parse_repeat(F.col("name")))


def tsv_file(spark, sf_dir):
    """Intervals written as one sorted file of tab-separated text, and read back."""
    itvs, path = s.intervals(spark, sf_dir), fresh(spark, "tsv-file")
    write_tsv(itvs, path, ["chrom", "st", "ord"], one_file=True)
    return spark.read.option("sep", "\t").option("header", True).schema(itvs.schema).csv(path)


def bed_regions(spark, sf_dir):
    """Regions of a BED file in which some stand more than once."""
    lines, path = F.concat_ws("\t", F.concat(F.lit("ctg"), F.col("o_custkey") % 4), F.col("o_custkey") * 7, F.col("o_custkey") * 7 + F.col("o_orderkey") % 3, F.lit("x")), fresh(spark, "bed-lines")
    s.table(spark, sf_dir, "orders").select(lines.alias("value")).write.text(path)
    return api.regions(spark, bed=path).select("chrom", "st", "end")


def region_errors(spark, sf_dir):
    """Regions that can't be called, with the reason."""
    key = F.col("o_orderkey")
    found = s.table(spark, sf_dir, "orders").select(key.alias("region_id"), F.when(key % 17 != 0, F.concat(F.lit("ctg"), F.col("o_custkey") % 5)).alias("chrom"), (key % 1000 - 20).alias("st"), (key % 1000 - 20 + key % 29 - 3).alias("end"))
    contigs = s.regions(spark).select("chrom", F.col("end").alias("length"))
    return api.region_errors(found, contigs).select("region_id", "chrom", "st", "end", "error")


def broken_regions(spark, sf_dir):
    """Regions that overlap parts of a file that can't be read."""
    found = s.intervals(spark, sf_dir).select(F.col("ord").alias("region_id"), "chrom", "st", "end")
    broken = s.ignored(spark, sf_dir).select("chrom", F.col("st").alias("start"), F.col("end").alias("until"), F.concat(F.lit("block "), "st").alias("error"))
    return api.broken_regions(found, broken)


def region_reads(spark, sf_dir):
    """Reads of a table laid out by contig and tile that overlap regions, one of each supplier."""
    path = fresh(spark, "reads-table")
    write_reads(s.reads(spark, sf_dir), path, tile=256)
    key = F.col("s_suppkey")
    wanted = s.table(spark, sf_dir, "supplier").filter(key % 4 != 3).select(F.concat(F.lit("ctg"), (key % 4).cast("string")).alias("chrom"), (key * 613 % 1999 + 1).alias("st"), (key * 613 % 1999 + 3).alias("end"))
    return read_reads(spark, path, wanted).groupBy("chrom", "start", "cigar", "mapq").agg(F.count("*").alias("n"))


def fasta_chunks(spark, sf_dir):
    """Sequences written as one FASTA file with its index, and read back in chunks by places.

    Each is 60 letters in lines of 25 after a title of 12 bytes, so a sequence's place follows from its number.
    """
    path, parts = f"{fresh(spark, 'fasta')}.fa", fresh(spark, "fasta-lines")
    title = F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    seq = F.translate(F.upper(F.rpad("p_name", 60, F.col("p_name"))), " ", "N")
    rows = s.table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), seq.alias("seq"))
    lines = F.concat(F.lit(">"), "title", *[x for i, n in ((1, 25), (26, 25), (51, 10)) for x in (F.lit("\n"), F.col("seq").substr(i, n))])
    rows.orderBy("p_partkey").select(lines.alias("value")).write.text(parts)
    join_parts(spark, parts, path)
    rows.select(F.concat_ws("\t", "title", F.lit(60), F.col("p_partkey") * 75 + 12, F.lit(25), F.lit(26)).alias("value")).write.text(path + ".fai")
    return read_fasta(spark, path, chunk=20)


def queries():
    own = [cigar_blocks, pileup_mapq_mean, pileup_mapq_median, rolling_mean_signal, peaks_keep_zero, peaks_drop_zero, signals_joined, classify_bases, status_intervals, above_median_runs, rolling_median_stats, bin_stats, merge_intervals_distance, merge_intervals_status, merge_bad, overlap_length_join, overlap_semi_join, overlap_majority, subtract_ignored, boundary_suppress, mergeable_chunks, min_size_filter, final_collapse, bed9_projection, status_colours, bad_bases, whole_genome_tiles, bed_lines, largest_repeat, bin_assign, range_medians, gap_close, region_calls, self_identity, peaks_single, above_runs_by_user, boundary_contigs, known_statuses, repeat_kinds, tsv_file, bed_regions, region_errors, broken_regions, region_reads, fasta_chunks]
    return {f.__name__: f for f in own}
