"""CRAM 3.0 alignments as a Spark data source: ``spark.read.format("cram").load(path)``, with ``path``.crai.

The index names every slice; a partition is one slice, or several of a container, so a file is read in parallel, and only slices that
overlap what is wanted are read.  A read's CIGAR follows from its features; as in every CRAM, a base that differs from the reference is
an M unless the option ``differences`` asks for = and X, and bases aren't restored, so no reference sequence is needed.

Of a slice only the data series that CIGAR, position and MAPQ need are decoded: others are passed over where they lie in blocks of their
own, which names, qualities and tags mostly do.  Codecs of blocks: raw, gzip, bzip2, lzma, rANS 4x8 of both orders.  Encodings of
series: external, Huffman, byte arrays by length or stop, beta, gamma, subexponential.  Not read: CRAM 2 and the block codecs of CRAM 3.1, Golomb encodings; an
error says so.  Blocks' checksums are compared.
Rows as of a BAM file: (chrom, start 1-based, cigar, mapq), and with the option ``errors`` rows about slices that can't be read.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql.datasource import DataSource, InputPartition

from .bam import SCHEMA, WITH_ERRORS, AlignmentReader
from .files import opened

#: Bytes in which a container's header is expected, slices of one container in a partition.
HEAD, SLICES = 1 << 16, 4
FILE_HEADER, COMPRESSION, SLICE, EXTERNAL, CORE = 0, 1, 2, 4, 5
#: Series that hold bytes and byte arrays; all others hold whole numbers.
BYTES, ARRAYS = ("FC", "BS", "BA", "QS"), ("RN", "IN", "SC", "BB", "QQ")
#: Series that a read's place, CIGAR and MAPQ come of.
NEEDED = ("BF", "CF", "RI", "RL", "AP", "FN", "FC", "FP", "DL", "IN", "SC", "BB", "RS", "PD", "HC", "MQ")
#: Series that a read feature of each code has, in order.
FEATURES = {"B": ("BA", "QS"), "X": ("BS",), "D": ("DL",), "I": ("IN",), "i": ("BA",), "b": ("BB",), "q": ("QQ",), "Q": ("QS",), "N": ("RS",), "S": ("SC",), "P": ("PD",), "H": ("HC",)}
#: Operations of features with a length of their own.
LENGTHS = {"D": "D", "N": "N", "P": "P", "H": "H"}


class Bytes:
    """A cursor over bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a block ends too early")
        self.at += n
        return out

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def itf8(self) -> int:
        """A whole number of 32 bits: the first byte's leading ones are the number of bytes behind it (the fifth has 4 bits)."""
        first = self.byte()
        if first < 0x80:
            return first
        if first < 0xF0:
            more = 1 + (first >= 0xC0) + (first >= 0xE0)
            return (first & 0xFF >> more + 1) << 8 * more | int.from_bytes(self.take(more), "big")
        rest = self.take(4)
        value = (first & 15) << 28 | int.from_bytes(rest[:3], "big") << 4 | rest[3] & 15
        return value - (value >> 31 << 32)

    def ltf8(self) -> int:
        """The same of 64 bits."""
        first = self.byte()
        more = 8 - (first ^ 0xFF).bit_length()
        value = (first & 0xFF >> min(8, more + 1)) << 8 * more | int.from_bytes(self.take(more), "big")
        return value - (value >> 63 << 64)

    def numbers(self) -> list[int]:
        return [self.itf8() for _ in range(self.itf8())]


class Bits:
    """Bits of the core block, highest first."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("the core block ends too early")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1


def frequencies(b: Bytes) -> tuple[list[int], list[int], bytes]:
    """Frequency and first place of each symbol among 4096, and the symbol at each place."""
    freq, symbol, run, last = [0] * 256, b.byte(), 0, -2
    while True:
        freq[symbol] = b.itf8()
        last = symbol
        if run:
            run, symbol = run - 1, symbol + 1
        else:
            symbol = b.byte()
            if symbol == last + 1:
                run = b.byte()
        if not symbol:
            break
    low, places = [0] * 256, bytearray()
    for s, f in enumerate(freq):
        low[s] = len(places)
        places += bytes([s]) * f
    if len(places) > 4096:
        raise ValueError("frequencies don't add up")
    return freq, low, bytes(places.ljust(4096, b"\0"))


def rans(data: bytes) -> bytes:
    """What rANS 4x8 has compressed: four interleaved states of 12 bits of frequency, symbols by themselves (order 0) or after the one before (order 1)."""
    b = Bytes(data)
    order, _, n = b.byte(), b.take(4), struct.unpack("<I", b.take(4))[0]
    if not n:
        return b""
    tables: dict[int, tuple] = {}
    if order == 0:
        tables[0] = frequencies(b)
    else:
        context, run = b.byte(), 0
        while True:
            tables[context] = frequencies(b)
            last = context
            if run:
                run, context = run - 1, context + 1
            else:
                context = b.byte()
                if context == last + 1:
                    run = b.byte()
            if not context:
                break
    state = list(struct.unpack("<4I", b.take(16)))
    out, at, raw = bytearray(n), b.at, b.data

    def step(k: int, table: tuple) -> int:
        nonlocal at
        freq, low, places = table
        x = state[k]
        place = x & 4095
        s = places[place]
        x = freq[s] * (x >> 12) + place - low[s]
        while x < 1 << 23:
            x = x << 8 | raw[at]
            at += 1
        state[k] = x
        return s

    if order == 0:
        table = tables[0]
        for i in range(n):
            out[i] = step(i & 3, table)
        return bytes(out)
    quarter, before = n // 4, [0] * 4
    for i in range(quarter):
        for k in range(4):
            before[k] = out[k * quarter + i] = step(k, tables[before[k]])
    for i in range(4 * quarter, n):
        before[3] = out[i] = step(3, tables[before[3]])
    return bytes(out)


CODECS: dict[int, Callable[[bytes], bytes]] = {0: bytes, 1: lambda x: zlib.decompress(x, 47), 2: bz2.decompress, 3: lzma.decompress, 4: rans}


class Block:
    def __init__(self, b: Bytes):
        start = b.at
        self.method, self.kind, self.id = b.byte(), b.byte(), b.itf8()
        size, self.size = b.itf8(), b.itf8()
        self.raw = b.take(size)
        if zlib.crc32(b.data[start : b.at]) != struct.unpack("<I", b.take(4))[0]:
            raise ValueError("a block's checksum is wrong")

    def data(self) -> bytes:
        if self.method not in CODECS:
            raise ValueError(f"block codec {self.method} isn't supported")
        out = CODECS[self.method](self.raw)
        if len(out) != self.size:
            raise ValueError("a block has the wrong size")
        return out


def container_head(b: Bytes) -> tuple[int, list[int]]:
    """Length of a container's blocks and where among them its slices begin; the cursor then stands at the first block."""
    length = struct.unpack("<i", b.take(4))[0]
    for _ in range(4):  # sequence, start, span, records
        b.itf8()
    b.ltf8(), b.ltf8(), b.itf8()  # counter, bases, blocks
    places = b.numbers()
    b.take(4)
    return length, places


def read_cram_header(f) -> tuple[list[tuple[str, int]], int]:
    """Names and lengths of the contigs, and the major version."""
    head = f.read(26)
    if head[:4] != b"CRAM":
        raise ValueError("not a CRAM file")
    if head[4] != 3:
        raise ValueError(f"CRAM {head[4]} isn't supported, CRAM 3 is")
    b = Bytes(f.read(HEAD))
    length, _ = container_head(b)
    if b.at + length > len(b.data):
        b.data += f.read(b.at + length - len(b.data))
    text = Block(b).data()
    text = text[4 : 4 + struct.unpack("<i", text[:4])[0]].decode()
    fields = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in text.splitlines() if line.startswith("@SQ\t")]
    return [(x["SN"], int(x["LN"])) for x in fields], head[4]


class Encoding:
    """How a series is laid out: which external blocks it has and whether it takes core bits; ``reader`` makes a function for a slice."""

    def __init__(self, b: Bytes):
        self.codec = b.itf8()
        p = Bytes(b.take(b.itf8()))
        self.ids, self.core, self.parts = set(), False, ()
        if self.codec == 1:
            self.id = p.itf8()
            self.ids = {self.id}
        elif self.codec == 3:
            symbols, sizes = p.numbers(), p.numbers()
            self.codes, code, before = {}, 0, 0
            for size, symbol in sorted(zip(sizes, symbols)):
                code <<= size - before
                self.codes[size, code] = symbol
                code, before = code + 1, size
            self.core = any(sizes)
        elif self.codec == 4:
            self.parts = Encoding(p), Encoding(p)
            self.ids, self.core = self.parts[0].ids | self.parts[1].ids, any(x.core for x in self.parts)
        elif self.codec == 5:
            self.stop, self.id = p.byte(), p.itf8()
            self.ids = {self.id}
        elif self.codec in (6, 7):
            self.offset, self.width, self.core = p.itf8(), p.itf8(), True
        elif self.codec == 9:
            self.offset, self.core = p.itf8(), True
        elif self.codec:
            raise ValueError(f"encoding {self.codec} isn't supported")

    def reader(self, kind: str, bits: Bits, external: Callable[[int], Bytes]) -> Callable:
        if kind == "array":
            if self.codec == 5:
                b = external(self.id)

                def until() -> bytes:
                    end = b.data.index(self.stop, b.at)
                    out, b.at = b.data[b.at : end], end + 1
                    return out

                return until
            if self.codec == 4:
                size = self.parts[0].reader("number", bits, external)
                if self.parts[1].codec == 1:
                    b = external(self.parts[1].id)
                    return lambda: b.take(size())
                one = self.parts[1].reader("byte", bits, external)
                return lambda: bytes([one() for _ in range(size())])
        if self.codec == 1:
            b = external(self.id)
            return b.byte if kind == "byte" else b.itf8
        if self.codec == 3:
            return self._huffman(bits)
        if self.codec == 6:
            return lambda: bits.take(self.width) - self.offset
        if self.codec == 7:
            return lambda: self._subexponential(bits)
        if self.codec == 9:
            return lambda: self._gamma(bits)
        raise ValueError(f"encoding {self.codec} doesn't suit its series")

    def _huffman(self, bits: Bits) -> Callable[[], int]:
        if not self.core:
            (only,) = self.codes.values()
            return lambda: only

        def read() -> int:
            code = size = 0
            while (size, code) not in self.codes:
                code, size = code << 1 | bits.take(1), size + 1
            return self.codes[size, code]

        return read

    def _subexponential(self, bits: Bits) -> int:
        n = 0
        while bits.take(1):
            n += 1
        return (bits.take(self.width) if not n else 1 << (w := n + self.width - 1) | bits.take(w)) - self.offset

    def _gamma(self, bits: Bits) -> int:
        n = 0
        while not bits.take(1):
            n += 1
        return (1 << n | bits.take(n)) - self.offset


class Layout:
    """A container's compression header."""

    def __init__(self, data: bytes):
        b = Bytes(data)
        self.names = self.delta = True
        tags: list[list[bytes]] = [[]]
        b.itf8()
        for _ in range(b.itf8()):
            key = b.take(2)
            if key == b"SM":
                b.take(5)
            elif key == b"TD":
                tags = [[line[i : i + 3] for i in range(0, len(line), 3)] for line in b.take(b.itf8()).split(b"\0")[:-1]]
            elif key in (b"RN", b"AP", b"RR"):
                value = bool(b.byte())
                self.names, self.delta = value if key == b"RN" else self.names, value if key == b"AP" else self.delta
            else:
                raise ValueError(f"no such entry: {key}")
        b.itf8()
        self.series: dict = {b.take(2).decode(): Encoding(b) for _ in range(b.itf8())}
        b.itf8()
        self.tags = {b.itf8(): Encoding(b) for _ in range(b.itf8())}
        self.lines = [[int.from_bytes(t, "big") for t in line] for line in tags]
        self.read = self._read()

    def _read(self) -> set:
        """Series and tags that have to be decoded: what is needed, what takes core bits, and what shares a block with any of these."""
        every = self.series | self.tags
        read = {k for k, e in every.items() if k in NEEDED or e.core}
        while True:
            ids = {i for k in read for i in every[k].ids}
            more = {k for k, e in every.items() if e.ids & ids} - read
            if read & {*self.tags} and "TL" in every:
                more |= {"TL"} - read
            if not more:
                return read
            read |= more


def slice_reads(layout: Layout, b: Bytes, differences: bool = False) -> Iterator[tuple[int, int, str, int]]:
    """(sequence, start from 0, cigar, mapq) of the mapped reads of a slice; the cursor stands at its header block."""
    head = Bytes(Block(b).data())
    ref, start, _, n = (head.itf8() for _ in range(4))
    head.ltf8()
    blocks = [Block(b) for _ in range(head.itf8())]
    core = next((x for x in blocks if x.kind == CORE), None)
    bits, held, cursors = Bits(core.data() if core else b""), {x.id: x for x in blocks if x.kind == EXTERNAL}, {}

    def external(i: int) -> Bytes:
        if i not in cursors:
            cursors[i] = Bytes(held[i].data() if i in held else b"")
        return cursors[i]

    kinds = {**dict.fromkeys(BYTES, "byte"), **dict.fromkeys(ARRAYS, "array")}
    passed = lambda: None
    get = {k: layout.series[k].reader(kinds.get(k, "number"), bits, external) if k in layout.read else passed for k in layout.series}
    tag = {k: e.reader("array", bits, external) if k in layout.read else passed for k, e in layout.tags.items()}
    series = lambda k: get[k]()
    same, other = ("=", "X") if differences else ("M", "M")
    for _ in range(n):
        flag, own = series("BF"), series("CF")
        at_ref = series("RI") if ref == -2 else ref
        length = series("RL")
        start = start + series("AP") if layout.delta else series("AP")
        series("RG")
        if layout.names:
            series("RN")
        if own & 2:
            series("MF")
            if not layout.names:
                series("RN")
            for k in ("NS", "NP", "TS"):
                series(k)
        elif own & 4:
            series("NF")
        line = series("TL")
        if line is not None:
            for t in layout.lines[line]:
                tag[t]()
        if flag & 4:
            if not own & 8:
                for _ in range(length):
                    series("BA")
            if own & 1:
                for _ in range(length):
                    series("QS")
            continue
        ops: list[tuple[str, int]] = []
        pos = done = 0  # read bases that the features so far reach to, and have accounted for
        for _ in range(series("FN")):
            code = chr(series("FC"))
            pos += series("FP")
            got = [series(k) for k in FEATURES[code]]
            if code in "Qq":
                continue
            if pos - 1 > done:
                ops.append((same, pos - 1 - done))
                done = pos - 1
            if code in LENGTHS:
                ops.append((LENGTHS[code], got[0]))
                continue
            size = len(got[0]) if code in "ISb" else 1
            ops.append(({"I": "I", "i": "I", "S": "S", "X": other}.get(code, "M"), size))
            done += size
        mapq = series("MQ")
        if own & 1:
            for _ in range(length):
                series("QS")
        if length > done:
            ops.append((same, length - done))
        yield at_ref, start - 1, "".join(f"{sum(k for _, k in group)}{op}" for op, group in groupby((x for x in ops if x[1]), lambda x: x[0])), mapq


def reference_span(cigar: str) -> int:
    total = n = 0
    for c in cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            total, n = total + n * (c in "MDN=X"), 0
    return total


class Slices(InputPartition):
    """Some slices of one container; reads that overlap ``spans`` (by sequence; first and last place counted from 0) are wanted, all if it is None."""

    def __init__(self, container: int, slices: list[tuple[int, int]], spans: dict | None, name: str, low: int, high: int):
        self.container, self.slices, self.spans, self.name, self.low, self.high = container, slices, spans, name, low, high


class CramReader(AlignmentReader):
    def __init__(self, options):
        super().__init__(options)
        self.differences = options.get("differences", "false") == "true"

    def partitions(self):
        with opened(self.path) as f:
            self.contigs, _ = read_cram_header(f)
        with opened(self.path + ".crai") as f:
            raw = f.read()
        lines = (zlib.decompress(raw, 47) if raw[:2] == b"\x1f\x8b" else raw).decode().split("\n")
        spans = {}
        for ref, (name, length) in enumerate(self.contigs):
            if self.only is None or self.only == name:
                spans[ref] = [(max(st, self.least - 1), min(end, self.most - 1)) if self.regions is None else (st, end) for st, end in self.wanted(name, length)]
        # by container: slice -> its size, and its span on each sequence
        found: dict[int, dict[int, tuple[int, list]]] = {}
        for ref, start, span, container, at, size in (map(int, x.split("\t")) for x in lines if x):
            # reads of a slice may reach beyond where they start, so what the index calls its span decides
            if any(st < start - 1 + span and end >= start - 1 for st, end in spans.get(ref, ())):
                found.setdefault(container, {}).setdefault(at, (size, []))[1].append((ref, start - 1, start - 1 + span))
        out = []
        for container, slices in sorted(found.items()):
            some = sorted((at, *x) for at, x in slices.items())
            for k in range(0, len(some), SLICES):
                part = some[k : k + SLICES]
                refs = [x for s in part for x in s[2]]
                # an error names the sequence, or none where the slices hold several
                ref = refs[0][0] if len({x[0] for x in refs}) == 1 else None
                name, low, high = ("", 0, 1 << 62) if ref is None else (self.contigs[ref][0], min(x[1] for x in refs), max(x[2] for x in refs))
                out.append(Slices(container, [(at, size) for at, size, _ in part], spans if self.regions is not None or len(spans) < len(self.contigs) else None, name, low, high))
        return out or [Slices(-1, [], None, "", 0, 0)]

    def rows(self, part):
        if part.container < 0:
            return
        with opened(self.path) as f:
            contigs = [x[0] for x in read_cram_header(f)[0]]
            f.seek(part.container)
            b = Bytes(f.read(HEAD))
            length, _ = container_head(b)
            first = b.at
            while True:
                try:
                    b.at = first
                    layout = Layout(Block(b).data())
                    break
                except ValueError:
                    if len(b.data) >= first + length or not (more := f.read(length)):
                        raise
                    b.data += more
            for at, size in part.slices:
                f.seek(part.container + first + at)
                for ref, start, cigar, mapq in slice_reads(layout, Bytes(f.read(size)), self.differences):
                    end = start + reference_span(cigar)
                    if part.spans is None or any(start <= b and (end > a or start >= a) for a, b in part.spans.get(ref, ())):
                        yield contigs[ref], start + 1, cigar, mapq


class CramSource(DataSource):
    @classmethod
    def name(cls):
        return "cram"

    def schema(self):
        return WITH_ERRORS if self.options.get("errors") == "true" else SCHEMA

    def reader(self, schema):
        return CramReader(self.options)
