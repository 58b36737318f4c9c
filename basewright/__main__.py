"""Command line: calls the regions of a BED file, or whole contigs, on an alignment file."""

from __future__ import annotations

import argparse
import csv
import sys

from pyspark.sql import SparkSession

from .api import call_file
from .config import read_config
from .sources.bed import write_bed9, write_tsv


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="basewright", description=__doc__)
    p.add_argument("alignments", help="BAM file with its index beside it")
    p.add_argument("--fasta", help="sequence with its .fai beside it")
    p.add_argument("--bed", help="regions; whole contigs in tiles without it")
    p.add_argument("--ignore", help="BED file of intervals to leave out")
    p.add_argument("--config", help="TOML file")
    p.add_argument("--preset", help="hifi, ont_r9 or ont_r10; goes before the file")
    p.add_argument("--threads", type=int, help="tasks at a time, where no cluster is set up")
    p.add_argument("--out", help="folder for the calls (BED9); standard output without it")
    p.add_argument("--pileup", help="folder for the table of bases")
    p.add_argument("--show-config", action="store_true", help="print the configuration and end")
    a = p.parse_args(args)
    if a.show_config:
        print(read_config(a.config, a.preset).describe())
        return 0
    builder = SparkSession.builder.appName("basewright")
    spark = (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    calls = call_file(spark, a.alignments, a.fasta, a.bed, a.ignore, a.config, a.preset)
    for r in calls.errors.toLocalIterator():
        print(f"left out: {r['chrom']}:{r['st']}-{r['end']}: {r['error']}", file=sys.stderr)
    if a.pileup:
        write_tsv(calls.pileup.drop("region_id"), a.pileup, ["chrom", "pos"])
    if a.out:
        write_bed9(calls.regions, a.out)
    else:
        rows = calls.regions.drop("region_id").withColumnRenamed("chrom", "#chrom").orderBy("#chrom", "chromStart")
        to = csv.writer(sys.stdout, delimiter="\t", lineterminator="\n")
        to.writerow(rows.columns)
        to.writerows(rows.toLocalIterator())
    return 0


if __name__ == "__main__":
    sys.exit(main())
