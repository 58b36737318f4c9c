"""Genomic inputs derived from the driver's tables, in Spark and in SQL.

Each pair holds the same rows: whole-number arithmetic only, and a total order
wherever one is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIGS, LENGTH = 4, 2000
STATUSES = ("good", "low_quality", "indel", "softclip", "collapse", "misjoin", "false_dupe")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read for each line item, and one for each customer.

    Items of lines 1 to 3 cover a contig but for two gaps.  Those of line 4 pile up with MAPQ 0 and deletions
    at one place, those of lines 5, 6 and 7 bring mismatches, deletions and clips to places of their own, and
    customers cover one of the gaps with MAPQ 0.  So bases of every status occur.
    """
    key = lambda c: F.concat(F.lit("ctg"), (F.col(c) % CONTIGS).cast("string")).alias("chrom")
    line, n, q, part = F.col("l_linenumber"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_orderkey") * 31 + F.col("l_partkey") * 17
    base = F.concat(n, F.lit("S"), q, F.lit("=1X"), n, F.lit("I"), q, F.lit("="), n, F.lit("D5="))
    cigar = F.when(line <= 3, base).when(line == 4, "10=2D10=").when(line == 5, "5X").when(line == 6, "3=4D3=").otherwise("9S1=")
    p = part % 1420 + 1
    start = F.when(line <= 3, F.when(p <= 1280, p).otherwise(p + 580)).when(line == 4, 600 + part % 12).when(line == 5, 900 + part % 3).when(line == 6, 1100 + part % 2).otherwise(1200)
    mapq = F.when(line == 4, 0).otherwise(F.round(F.col("l_discount") * 600).cast("int"))
    items = table(spark, sf_dir, "lineitem").select(key("l_suppkey"), start.cast("int").alias("start"), cigar.alias("cigar"), mapq.alias("mapq"))
    more = table(spark, sf_dir, "customer").select(key("c_custkey"), (1650 + F.col("c_custkey") % 100).cast("int").alias("start"), F.lit("40=").alias("cigar"), F.lit(0).alias("mapq"))
    return items.unionByName(more)


def regions(spark: SparkSession) -> DataFrame:
    return spark.range(CONTIGS).select(F.col("id").alias("region_id"), F.concat(F.lit("ctg"), F.col("id").cast("string")).alias("chrom"), F.lit(1).cast("long").alias("st"), F.lit(LENGTH).cast("long").alias("end"))


def bins(spark: SparkSession) -> DataFrame:
    """The first half of each contig is a bin of its own."""
    return regions(spark).select("region_id", F.lit(1).cast("long").alias("bin"), F.lit(1).cast("long").alias("st"), F.lit(LENGTH // 2).cast("long").alias("end"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (region_id, pos, cov) of whole-number values in the order of time, by type of event."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("region_id"), F.row_number().over(w).cast("long").alias("pos"), F.floor("value").cast("long").alias("cov"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval for each order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (key % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        (cust % 16).alias("region_id"), F.concat(F.lit("ctg"), (cust % 16 % CONTIGS).cast("string")).alias("chrom"), (key * 37 % 20011).alias("st"), (key * 37 % 20011 + 1 + cust % 40).alias("end"),
        key.alias("ord"), status.alias("status"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("cov"), (cust % 3).alias("bin"),
    )


def ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals to leave out, one for each supplier."""
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("ctg"), (F.col("s_suppkey") % CONTIGS).cast("string")).alias("chrom"), (F.col("s_suppkey") * 613 % 20011).alias("st"), (F.col("s_suppkey") * 613 % 20011 + 25).alias("end"))


READS = f"""reads AS (SELECT 'ctg' || (l_suppkey % {CONTIGS}) AS chrom, l_suppkey % {CONTIGS} AS region_id, l_linenumber AS n, (l_orderkey * 31 + l_partkey * 17) % 1420 + 1 + CASE WHEN (l_orderkey * 31 + l_partkey * 17) % 1420 + 1 <= 1280 THEN 0 ELSE 580 END AS s,
  l_orderkey * 31 + l_partkey * 17 AS p, CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 600) AS INT) AS mapq FROM lineitem)"""
BLOCKS = f"""{READS}, blocks AS (
  SELECT region_id, chrom, 'S' AS op, s AS b_st, s AS b_end, mapq FROM reads WHERE n <= 3
  UNION ALL SELECT region_id, chrom, 'C', s, s + q - 1, mapq FROM reads WHERE n <= 3
  UNION ALL SELECT region_id, chrom, 'X', s + q, s + q, mapq FROM reads WHERE n <= 3
  UNION ALL SELECT region_id, chrom, 'I', s + q + 1, s + q + 1, mapq FROM reads WHERE n IN (2, 3)
  UNION ALL SELECT region_id, chrom, 'C', s + q + 1, s + 2 * q, mapq FROM reads WHERE n <= 3
  UNION ALL SELECT region_id, chrom, CASE WHEN n >= 2 THEN 'D' ELSE 'C' END, s + 2 * q + 1, s + 2 * q + n, mapq FROM reads WHERE n <= 3
  UNION ALL SELECT region_id, chrom, 'C', s + 2 * q + 1 + n, s + 2 * q + 5 + n, mapq FROM reads WHERE n <= 3
  UNION ALL SELECT region_id, chrom, unnest(['C', 'D', 'C']), unnest([0, 10, 12]) + 600 + p % 12, unnest([9, 11, 21]) + 600 + p % 12, 0 FROM reads WHERE n = 4
  UNION ALL SELECT region_id, chrom, 'X', 900 + p % 3, 904 + p % 3, mapq FROM reads WHERE n = 5
  UNION ALL SELECT region_id, chrom, unnest(['C', 'D', 'C']), unnest([0, 3, 7]) + 1100 + p % 2, unnest([2, 6, 9]) + 1100 + p % 2, mapq FROM reads WHERE n = 6
  UNION ALL SELECT region_id, chrom, unnest(['S', 'C']), 1200, 1200, mapq FROM reads WHERE n = 7
  UNION ALL SELECT c_custkey % {CONTIGS}, 'ctg' || (c_custkey % {CONTIGS}), 'C', 1650 + c_custkey % 100, 1689 + c_custkey % 100, 0 FROM customer),
clipped AS (SELECT region_id, chrom, op, greatest(b_st, 1) AS b_st, least(b_end, {LENGTH}) AS b_end, mapq FROM blocks WHERE b_st <= {LENGTH} AND b_end >= b_st)"""


def pile(q: str) -> str:
    return f"""{BLOCKS}, bases AS (SELECT region_id, op, CASE WHEN op IN ('C', 'X') THEN mapq END AS mq, unnest(range(b_st, b_end + 1)) AS pos FROM clipped),
counted AS (SELECT region_id, pos, count(mq) AS cov, count(*) FILTER (op = 'X') AS mismatch, max(mq) AS mapq_max, {q} AS mapq, count(*) FILTER (op IN ('I', 'D')) AS indel, count(*) FILTER (op = 'S') AS softclip FROM bases GROUP BY ALL),
pile AS (SELECT r.region_id, 'ctg' || r.region_id AS chrom, r.pos, coalesce(cov, 0) AS cov, coalesce(mismatch, 0) AS mismatch, CAST(coalesce(mapq_max, 0) AS INT) AS mapq_max, CAST(coalesce(mapq, 0) AS INT) AS mapq, coalesce(indel, 0) AS indel, coalesce(softclip, 0) AS softclip
  FROM (SELECT region_id, unnest(range(1, {LENGTH} + 1)) AS pos FROM range({CONTIGS}) t(region_id)) r LEFT JOIN counted c USING (region_id, pos))"""


MEAN_PILE, MEDIAN_PILE = pile("(sum(mq) + count(mq) - 1) // count(mq)"), pile("ceil(median(mq))")
SIGNAL = "signal AS (SELECT event_type AS region_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos, CAST(floor(value) AS BIGINT) AS cov FROM events)"
INTERVALS = f"""itvs AS (SELECT o_custkey % 16 AS region_id, 'ctg' || (o_custkey % 16 % {CONTIGS}) AS chrom, o_orderkey * 37 % 20011 AS st, o_orderkey * 37 % 20011 + 1 + o_custkey % 40 AS "end",
  o_orderkey AS ord, ({list(STATUSES)})[o_orderkey % 7 + 1] AS status, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cov, o_custkey % 3 AS bin FROM orders)"""
IGNORED = f"""ignored AS (SELECT 'ctg' || (s_suppkey % {CONTIGS}) AS chrom, s_suppkey * 613 % 20011 AS st, s_suppkey * 613 % 20011 + 25 AS "end" FROM supplier)"""
