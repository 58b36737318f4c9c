"""Tables of reads laid out so that regions read only the parts they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import range_join

#: Bases of a contig in a part of the table.
TILE = 1 << 20


def reference_end() -> F.Column:
    """The last position that a read (start, cigar) covers."""
    lengths = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), lambda x: x.cast("long"))
    return F.col("start").cast("long") + F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x) - 1


def write_reads(reads: DataFrame, path: str, tile: int = TILE) -> None:
    """The reads (chrom, start, cigar, mapq) in parts by contig and tile of their start, in the order of their starts; beside them each part's farthest end.

    A tile's reads go to tasks by ranges of their start, so a crowded tile becomes several files, not one task."""
    rows = reads.withColumns({"end": reference_end(), "tile": F.floor((F.col("start") - 1) / tile)})
    rows.repartitionByRange("chrom", "tile", "start", F.xxhash64("cigar", "mapq")).sortWithinPartitions("chrom", "tile", "start").write.partitionBy("chrom", "tile").parquet(f"{path}/reads", mode="overwrite")
    written = reads.sparkSession.read.parquet(f"{path}/reads")
    # a row for each part that there is
    written.groupBy("chrom", "tile").agg(F.max("end").alias("farthest"), F.min("start").cast("long").alias("first")).coalesce(1).write.parquet(f"{path}/parts", mode="overwrite")


def read_reads(spark: SparkSession, path: str, regions: DataFrame | None = None) -> DataFrame:
    """The table's reads, or those that overlap regions (chrom, st, end; closed, 1-based), each once.

    Regions meet the small table of parts; Spark prunes all other parts when the query runs.
    """
    reads = spark.read.parquet(f"{path}/reads")
    if regions is None:
        return reads.select("chrom", "start", "cigar", "mapq")
    parts = spark.read.parquet(f"{path}/parts").filter("farthest >= first")
    wanted = regions.select("chrom", F.col("st").cast("long").alias("r_st"), F.col("end").cast("long").alias("r_end")).distinct()
    # as many rows as there are parts at most, which were one row a tile of the axis when they were written
    needed = range_join(parts, wanted, ["chrom"], ("first", "farthest"), ("r_st", "r_end")).select("chrom", "tile").distinct()
    rows = reads.join(F.broadcast(needed), ["chrom", "tile"], "left_semi").select("chrom", F.col("start").cast("long").alias("x_st"), F.col("end").alias("x_end"), "start", "cigar", "mapq")
    hit = range_join(rows.select("chrom", "x_st", "x_end").distinct(), wanted, ["chrom"], ("x_st", "x_end"), ("r_st", "r_end")).select("chrom", "x_st", "x_end").distinct()
    return rows.join(hit, ["chrom", "x_st", "x_end"], "left_semi").select("chrom", "start", "cigar", "mapq")
