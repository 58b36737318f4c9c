"""BED text in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh
from .files import join_parts


def parse_bed(lines: DataFrame) -> DataFrame:
    """Rows (chrom, st, end, tail) of a column ``value``; a line without three fields or whole-number ends is left out."""
    f = F.split("value", "\t", 4)
    return lines.select(F.try_element_at(f, F.lit(1)).alias("chrom"), F.try_element_at(f, F.lit(2)).try_cast("long").alias("st"), F.try_element_at(f, F.lit(3)).try_cast("long").alias("end"), F.try_element_at(f, F.lit(4)).alias("tail")).filter("chrom is not null and st >= 0 and end >= 0")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))


def read_ignored(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Intervals to leave out, or None without a file; one that can't be read counts as none."""
    from pyspark.errors import AnalysisException

    if path is None:
        return None
    try:
        return read_bed(spark, path).select("chrom", "st", "end")
    except AnalysisException:
        return None


def write_tsv(frame: DataFrame, path: str, order: list[str] | None = None, header: bool = True, one_file: bool = False) -> None:
    """Tab-separated text in the folder ``path``, sorted by ranges that make a part each; with ``one_file`` these parts become one file."""
    spark = frame.sparkSession
    out = frame.orderBy(*order) if order else frame
    save = lambda rows, to, titles: rows.write.option("sep", "\t").option("header", titles).option("comment", "\x01").csv(to)  # noqa: E731  else a first "#" is quoted
    if not one_file:
        save(out, path, header)
        return
    # the titles as the same writer quotes them
    save(frame.limit(0).coalesce(1), f"{path}/_titles", header)
    parts = fresh(spark, "tsv-parts")
    save(out, parts, False)
    titles = spark.read.text(f"{path}/_titles").head()
    join_parts(spark, parts, f"{path}/part-00000.csv", (titles[0] + "\n").encode() if titles else b"")
    for done in (parts, f"{path}/_titles"):
        where = spark._jvm.org.apache.hadoop.fs.Path(done)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_bed9(calls: DataFrame, path: str) -> None:
    named = calls.drop("region_id").withColumnRenamed("chrom", "#chrom")
    write_tsv(named, path, ["#chrom", "chromStart"])


def write_intervals(frame: DataFrame, path: str) -> None:
    """Debug output (first, last, metadata) without a header."""
    write_tsv(frame, path, header=False)
