"""BAM alignments as a Spark data source: ``spark.read.format("bam").load(path)``.

The index, ``path``.bai or else ``path``.csi (whose bins suit contigs of any length), says by hierarchical bins which stretches of the
file hold a range's records, and by the first record that reaches into a window where it can begin; these stretches, joined where they touch, have
both a start and an end.  Each contig is cut into partitions, so a file is read in parallel and each task inflates its own
blocks.  Pushed filters on chrom (equality) and start (ranges) prune partitions and records.  ``read_bam`` with regions reads only what overlaps them.
Rows: (chrom, start 1-based, cigar, mapq); unmapped records are left out.  A CIGAR of more operations
than a record's field holds is taken from its CG tag.

With the option ``errors`` a part of the file that can't be read ends no job: it becomes a row of (chrom, start, until, error), which
says that reads that overlap these positions may be missing.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .files import opened

OPS = "MIDNSHP=X"
#: Bases of a contig in a partition.
SPAN = 1 << 20
SCHEMA = "chrom string, start int, cigar string, mapq int"
WITH_ERRORS = SCHEMA + ", until long, error string"
#: Bytes that are read of a file at a time.
AHEAD = 1 << 18


class Bgzf:
    """Random access into a blocked gzip file by virtual offsets."""

    def __init__(self, f):
        self.f, self.data, self.at, self.base, self.next, self.raw, self.raw_at = f, b"", 0, 0, 0, b"", 0

    def seek(self, virtual: int) -> None:
        if self.data and virtual >> 16 == self.base:
            self.at = virtual & 0xFFFF
            return
        self._load(virtual >> 16)
        self.at = virtual & 0xFFFF

    def tell(self) -> int:
        return (self.base << 16 | self.at) if self.at < len(self.data) else self.next << 16

    def _bytes(self, offset: int, n: int) -> bytes:
        """Bytes of the file, of which stretches are read ahead."""
        if not self.raw_at <= offset or offset + n > self.raw_at + len(self.raw):
            self.f.seek(offset)
            self.raw, self.raw_at = self.f.read(max(n, AHEAD)), offset
        return self.raw[offset - self.raw_at : offset - self.raw_at + n]

    def _load(self, offset: int) -> bool:
        head = self._bytes(offset, 18)
        self.base, self.at, self.data = offset, 0, b""
        if not head:
            self.next = offset
            return False
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
            raise ValueError(f"no block at byte {offset}")
        size = struct.unpack("<H", head[16:18])[0] + 1
        self.data = zlib.decompress(self._bytes(offset, size), 31)
        self.next = offset + size
        return True

    def read(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if self.at >= len(self.data) and not self._load(self.next):
                break
            part = self.data[self.at : self.at + left]
            self.at += len(part)
            left -= len(part)
            parts.append(part)
        return b"".join(parts)

    def exactly(self, n: int) -> bytes:
        out = self.read(n)
        if len(out) < n:
            raise ValueError("the file ends inside a record")
        return out


def read_header(z: Bgzf) -> list[tuple[str, int]]:
    """Names and lengths of the contigs."""
    z.seek(0)
    if z.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    z.read(struct.unpack("<i", z.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", z.read(4))[0]):
        n = struct.unpack("<i", z.read(4))[0]
        name = z.read(n)[:-1].decode()
        out.append((name, struct.unpack("<i", z.read(4))[0]))
    return out


class Index:
    """Bins of each contig: number -> stretches of virtual offsets; and where records that reach into a place can begin."""

    def __init__(self, data: bytes):
        if data[:2] == b"\x1f\x8b":
            data = b"".join(inflated(data))
        self.csi = data[:4] == b"CSI\1"
        if not self.csi and data[:4] != b"BAI\1":
            raise ValueError("not a BAI or CSI file")
        self.shift, self.depth, at = 14, 5, 4
        if self.csi:
            self.shift, self.depth, aux = struct.unpack_from("<iii", data, 4)
            at = 16 + aux
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.least: list[dict[int, int]] = []
        head = "<IQi" if self.csi else "<Ii"
        for _ in range(self._int(data, at)):
            at, bins, least = at + 4, {}, {}
            n = self._int(data, at)
            at += 4
            for _ in range(n):
                number, *first, chunks = struct.unpack_from(head, data, at)
                at += struct.calcsize(head)
                ends = struct.unpack_from(f"<{2 * chunks}Q", data, at)
                at += 16 * chunks
                if number < self.first_bin(self.depth + 1):  # a bin beyond holds counts
                    bins[number] = list(zip(ends[::2], ends[1::2]))
                    if first:
                        least[number] = first[0]
            if not self.csi:
                n = self._int(data, at)
                least = dict(enumerate(struct.unpack_from(f"<{n}Q", data, at + 4)))
                at += 4 + 8 * n
            self.bins.append(bins)
            self.least.append(least)
            at -= 4
        self.longest = 1 << self.shift + 3 * self.depth

    @staticmethod
    def _int(data: bytes, at: int) -> int:
        return struct.unpack_from("<i", data, at)[0]

    @staticmethod
    def first_bin(level: int) -> int:
        return ((1 << 3 * level) - 1) // 7

    def begin(self, ref: int, at: int) -> int:
        """Least virtual offset of a record that reaches into or behind a place."""
        least = self.least[ref]
        if not self.csi:
            return least.get(min(at >> self.shift, len(least) - 1), 0) if least else 0
        for level in range(self.depth, -1, -1):  # the smallest bin there is that holds the place
            number = self.first_bin(level) + (at >> self.shift + 3 * (self.depth - level))
            if number in least:
                return least[number]
        return 0

    def stretches(self, ref: int, low: int, high: int) -> list[tuple[int, int]]:
        """Stretches (from, to) of the file with all records that overlap [low, high), counted from 0; those that touch are one."""
        if high > self.longest:
            raise ValueError(f"the index holds places below {self.longest}; a CSI index of more depth is needed")
        found, bins, begin = [], self.bins[ref], self.begin(ref, low)
        for level in range(self.depth + 1):
            shift, first = self.shift + 3 * (self.depth - level), self.first_bin(level)
            a, b = first + (low >> shift), first + (high - 1 >> shift)
            numbers = range(a, b + 1) if b - a < len(bins) else [n for n in bins if a <= n <= b]
            found += [(max(st, begin), end) for n in numbers for st, end in bins.get(n, ()) if end > begin]
        out: list[list[int]] = []
        for st, end in sorted(found):
            if out and st >> 16 <= out[-1][1] >> 16:  # in one block
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([st, end])
        return [tuple(x) for x in out]


def inflated(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one behind the other."""
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data)
        data = z.unused_data


def read_index(path: str) -> Index:
    for end in (".bai", ".csi"):
        try:
            with opened(path + end) as f:
                return Index(f.read())
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"{path}.bai or {path}.csi")


def long_cigar(body: bytes, at: int) -> tuple[int, ...] | None:
    """The operations in the CG tag of a record whose tags begin there."""
    sizes = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
    while at + 3 <= len(body):
        tag, kind = body[at : at + 2], body[at + 2 : at + 3]
        at += 3
        if kind in (b"Z", b"H"):
            at = body.index(b"\0", at) + 1
        elif kind == b"B":
            n = struct.unpack_from("<i", body, at + 1)[0]
            if tag == b"CG" and body[at : at + 1] == b"I":
                return struct.unpack_from(f"<{n}I", body, at + 5)
            at += 5 + n * sizes[body[at : at + 1]]
        else:
            at += sizes[kind]
    return None


def records(z: Bgzf, stretches: list[tuple[int, int]], ref: int, low: int, high: int, after: int | None = None) -> Iterator[tuple[int, str, int]]:
    """(start, cigar, mapq) of the records of a contig that start in [low, high), in some stretches of the file; with ``after``
    also those that start behind that position and before low, but reach it."""
    for begin, stop in stretches:
        z.seek(begin)
        while z.tell() < stop and len(head := z.read(4)) == 4:
            size = struct.unpack("<i", head)[0]
            if size < 32:
                raise ValueError("a record is too short")
            body = z.exactly(size)
            own, pos, name_len, mapq, _, n_ops, flag, l_seq = struct.unpack_from("<iiBBHHHi", body)
            if own != ref or pos >= high:
                break
            if pos < low and (after is None or pos <= after) or flag & 4:
                continue
            ops = struct.unpack_from(f"<{n_ops}I", body, 32 + name_len)
            if n_ops == 2 and ops[0] == l_seq << 4 | 4 and ops[1] & 15 == 3:  # a clip of the whole read and a skip stand for a long CIGAR
                ops = long_cigar(body, 32 + name_len + 8 + (l_seq + 1) // 2 + l_seq) or ops
            if pos < low and pos + sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8)) <= low:
                continue
            yield pos + 1, "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops), mapq


class Part(InputPartition):
    """Starts in [low, high) of a contig, and reads from behind ``after`` that reach into it."""

    def __init__(self, name: str, low: int, high: int, stretches: list[tuple[int, int]], ref: int = -1, after: int | None = None):
        self.name, self.low, self.high, self.stretches, self.ref, self.after = name, low, high, stretches, ref, after


def merged(regions: list[list[int]]) -> list[list[int]]:
    """Overlapping and touching (st, end) as one, in order."""
    out: list[list[int]] = []
    for st, end in sorted(regions):
        if out and st <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([st, end])
    return out


class AlignmentReader(DataSourceReader):
    """What readers of alignment files share: filters, regions, and rows for parts that can't be read."""

    def __init__(self, options):
        self.path, self.only, self.least, self.most = options["path"], None, 1, 1 << 62
        self.regions = json.loads(options["regions"]) if "regions" in options else None
        self.errors = options.get("errors", "false") == "true"

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if not self.errors:  # rows about errors are never filtered out
                if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                    self.only = f.value
                elif getattr(f, "attribute", None) == ("start",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                    if not isinstance(f, (LessThan, LessThanOrEqual)):
                        self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                    if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                        self.most = min(self.most, f.value - isinstance(f, LessThan))
            yield f  # Spark filters too

    def wanted(self, name: str, length: int) -> list[list[int]]:
        """Positions (first, last) counted from 0, in order and apart."""
        return [[0, max(0, length - 1)]] if self.regions is None else merged([[max(0, st - 1), end - 1] for st, end in self.regions.get(name, []) if end >= 1])

    def read(self, partition):
        if not self.errors:
            yield from self.rows(partition)
            return
        try:
            for row in self.rows(partition):
                yield (*row, None, None)
        except (ValueError, IndexError, KeyError, EOFError, struct.error, zlib.error, OSError) as why:
            yield partition.name, partition.low + 1, None, None, partition.high, f"{type(why).__name__}: {why}"


class BamReader(AlignmentReader):
    def partitions(self):
        with opened(self.path) as f:
            contigs = read_header(Bgzf(f))
        index, out = read_index(self.path), []
        for ref, (name, length) in enumerate(contigs):
            if self.only is not None and name != self.only or ref >= len(index.bins) or not index.bins[ref]:
                continue
            before = -1
            for st, end in self.wanted(name, length):
                first, last = max(st, self.least - 1), min(end, self.most - 1, max(0, length - 1))
                for k in range(first // SPAN, last // SPAN + 1):
                    low, high = max(first, k * SPAN), min(last + 1, (k + 1) * SPAN)
                    # a read that reaches several regions belongs to the first
                    after = before if self.regions is not None and low == st else None
                    if low < high and (found := index.stretches(ref, low, high)):
                        out.append(Part(name, low, high, found, ref, after))
                before = end
        return out or [Part("", 0, 0, [])]

    def rows(self, part):
        if not part.stretches:
            return
        with opened(self.path) as f:
            for row in records(Bgzf(f), part.stretches, part.ref, part.low, part.high, part.after):
                yield (part.name, *row)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return WITH_ERRORS if self.options.get("errors") == "true" else SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def read_alignments(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, errors: bool = False) -> DataFrame:
    """A BAM or CRAM file's reads, or those that overlap some regions (chrom, st, end; closed, 1-based), each once; with ``errors`` also rows about
    parts that can't be read."""
    from .cram import CramSource

    source = CramSource if path.endswith(".cram") else BamSource
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(source.name()).option("errors", str(errors).lower())
    if regions is not None:
        by: dict[str, list] = {}
        for chrom, st, end in regions:
            by.setdefault(chrom, []).append([st, end])
        reader = reader.option("regions", json.dumps(by))
    return reader.load(path)


def read_bam(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """The file's reads, or those that overlap some regions (chrom, st, end; closed, 1-based), each once."""
    return read_alignments(spark, path, regions)


def contigs_of(path: str) -> list[tuple[str, int]]:
    from .cram import read_cram_header

    with opened(path) as f:
        return read_cram_header(f)[0] if path.endswith(".cram") else read_header(Bgzf(f))


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (chrom, length) from the header of a BAM or CRAM file."""
    return spark.createDataFrame(contigs_of(path), "chrom string, length long")
