"""FASTA sequence and its index."""

from __future__ import annotations

import struct
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Chunks that one task reads, about.
CHUNKS = 2000


class Unzipped:
    """A FASTA file by places of its text: the plain file itself, or one of blocked gzip by its index ``.gzi`` of where blocks start."""

    def __init__(self, f, index: bytes | None = None):
        from .bam import Bgzf

        self.f, self.blocks = f, None
        if index is not None:
            pairs = struct.unpack_from(f"<{2 * struct.unpack_from('<Q', index)[0]}Q", index, 8)
            self.blocks, self.starts, self.z = [0, *pairs[::2]], [0, *pairs[1::2]], Bgzf(f)

    def read(self, place: int, n: int) -> bytes:
        if self.blocks is None:
            self.f.seek(place)
            return self.f.read(n)
        k = bisect_right(self.starts, place) - 1
        self.z.seek(self.blocks[k] << 16)
        # within the block by its own offset: seeking to it needs the block to be loaded
        self.z.at = place - self.starts[k]
        return self.z.read(n)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """Rows (chrom, length, offset, linebases, linewidth)."""
    return spark.read.option("sep", "\t").schema("chrom string, length long, offset long, linebases long, linewidth long").csv(path)


def read_fasta(spark: SparkSession, path: str, chunk: int = 5_000) -> DataFrame:
    """Rows (chrom, start 1-based, seq) of ``chunk`` bases each, by way of ``path``.fai.

    Each chunk's byte range follows from the index, so chunks are dealt out in runs of neighbours and read
    on their own, wherever a task runs; the file must be reachable from the executors by path or URI.
    A file of blocked gzip (``.gz`` or ``.bgz``) has its index of blocks in ``path``.gzi, and a task inflates only the blocks of its chunks.
    """
    import pandas as pd

    from .files import opened

    plan = read_fai(spark, path + ".fai").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk).cast("long"))).alias("at"))
    n = max(1, plan.count() // CHUNKS)
    plan = plan.repartitionByRange(n, "offset", "at") if n > 1 else plan

    def read(batches):
        index = None
        if path.endswith((".gz", ".bgz")):
            with opened(path + ".gzi") as f:
                index = f.read()
        with opened(path) as f:
            text = Unzipped(f, index)
            for b in batches:
                seqs = []
                for r in b.itertuples():
                    n = min(chunk, r.length - r.at)
                    place = lambda i, r=r: r.offset + i // r.linebases * r.linewidth + i % r.linebases
                    seqs.append(text.read(place(r.at), place(r.at + n) - place(r.at)).replace(b"\n", b"").replace(b"\r", b"").decode())
                yield pd.DataFrame({"chrom": b["chrom"], "start": b["at"] + 1, "seq": seqs})

    return plan.mapInPandas(read, "chrom string, start long, seq string")
