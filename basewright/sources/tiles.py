"""Whole-genome tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiles(contigs: DataFrame, window: int) -> DataFrame:
    """Rows (chrom, st, end): windows of the contigs (chrom, length) that share their ends, and the rest
    of each contig, of length 0 where the window divides it."""
    i = contigs.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / window))).alias("i"))
    return i.select("chrom", (F.col("i") * window).alias("st"), F.least((F.col("i") + 1) * window, F.col("length")).alias("end"))
