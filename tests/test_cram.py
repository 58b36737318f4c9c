"""CRAM files written by an encoder of the tests give the rows of the reads they hold."""

import bz2
import gzip
import lzma
import random
import struct
import zlib
from itertools import groupby

import pytest

from basewright import api
from basewright.sources import cram
from basewright.sources.bam import bam_contigs, read_alignments


def itf8(n):
    n &= 0xFFFFFFFF
    for more in range(4):
        if n < 1 << 7 * (more + 1):
            return bytes([0xFF << 8 - more & 0xFF | n >> 8 * more]) + (n & (1 << 8 * more) - 1).to_bytes(more, "big")
    return bytes([0xF0 | n >> 28, n >> 20 & 255, n >> 12 & 255, n >> 4 & 255, n & 15])


def ltf8(n):
    for more in range(8):
        if n < 1 << 7 * (more + 1):
            return bytes([0xFF << 8 - more & 0xFF | n >> 8 * more]) + (n & (1 << 8 * more) - 1).to_bytes(more, "big")
    return b"\xff" + n.to_bytes(8, "big")


def array(xs):
    return itf8(len(xs)) + b"".join(map(itf8, xs))


def scaled(counts):
    """Frequencies that add up to 4096, none 0."""
    total = sum(counts.values())
    out = {s: max(1, c * 4096 // total) for s, c in counts.items()}
    while (over := sum(out.values()) - 4096) > 0:
        most = max(out, key=out.get)
        out[most] -= min(over, out[most] - 1)
    out[max(out, key=out.get)] -= over
    return out


def runs(symbols, body):
    """A list of symbols with runs, each followed by its body, and a zero."""
    out, left, before = b"", 0, -2
    for k, s in enumerate(symbols):
        if left:
            left -= 1
        else:
            out += bytes([s])
            if s == before + 1:
                while k + 1 + left < len(symbols) and symbols[k + 1 + left] == s + left + 1:
                    left += 1
                out += bytes([left])
        out, before = out + body(s), s
    return out + b"\0"


def rans(data, order):
    count = lambda xs: {s: xs.count(s) for s in set(xs)}
    n, quarter = len(data), len(data) // 4
    if not n:
        return struct.pack("<BII", order, 0, 0)
    if order:
        before = [0 if i in (0, quarter, 2 * quarter, 3 * quarter) and i < 4 * quarter or not i else data[i - 1] for i in range(n)]
        tables = {c: scaled(count([s for s, b in zip(data, before) if b == c])) for c in sorted(set(before))}
    else:
        before, tables = [0] * n, {0: scaled(count(list(data)))}
    low = {c: dict(zip(sorted(t), [sum(t[x] for x in sorted(t)[:k]) for k in range(len(t))])) for c, t in tables.items()}
    table = lambda c: runs(sorted(tables[c]), lambda s: itf8(tables[c][s]))
    head = runs(sorted(tables), table) if order else table(0)
    state, out = [1 << 23] * 4, bytearray()
    if order:
        steps = [(k, k * quarter + i) for i in range(quarter) for k in range(4)] + [(3, i) for i in range(4 * quarter, n)]
    else:
        steps = [(i & 3, i) for i in range(n)]
    for k, i in reversed(steps):
        f, x = tables[before[i]][data[i]], state[k]
        while x >= f << 19:
            out.append(x & 255)
            x >>= 8
        state[k] = (x // f << 12) + x % f + low[before[i]][data[i]]
    body = head + struct.pack("<4I", *state) + bytes(reversed(out))
    return struct.pack("<BII", order, len(body), n) + body


METHODS = [(0, bytes), (1, gzip.compress), (2, bz2.compress), (3, lzma.compress), (4, lambda x: rans(x, 0)), (4, lambda x: rans(x, 1))]


def block(kind, number, data, method=0):
    code, squeeze = METHODS[method]
    raw = squeeze(data)
    out = bytes([code, kind]) + itf8(number) + itf8(len(raw)) + itf8(len(data)) + raw
    return out + struct.pack("<I", zlib.crc32(out))


def container(ref, start, span, n, blocks, places, counter=0):
    body = b"".join(blocks)
    head = struct.pack("<i", len(body)) + itf8(ref) + itf8(start) + itf8(span) + itf8(n) + ltf8(counter) + ltf8(0) + itf8(len(blocks)) + array(places)
    return head + struct.pack("<I", zlib.crc32(head)) + body, len(head) + 4


class Writer:
    """One slice's streams: external blocks by number, and the core's bits."""

    def __init__(self, encodings):
        self.encodings, self.bits, self.streams = encodings, "", {}

    def put(self, key, value):
        self._put(self.encodings[key], value, key in cram.BYTES)

    def _put(self, e, value, byte):
        kind = e[0]
        if kind == "external":
            self.streams[e[1]] = self.streams.get(e[1], b"") + (bytes([value]) if byte else itf8(value))
        elif kind == "stop":
            self.streams[e[2]] = self.streams.get(e[2], b"") + value + bytes([e[1]])
        elif kind == "length":
            self._put(e[1], len(value), False)
            for x in value:
                self._put(e[2], x, True)
        elif kind == "huffman":
            self.bits += codes(e[1])[value]
        elif kind == "beta":
            self.bits += format(value + e[1], f"0{e[2]}b") if e[2] else ""
        elif kind == "gamma":
            x = bin(value + e[1])[2:]
            self.bits += "0" * (len(x) - 1) + x
        elif kind == "sub":
            x, k = value + e[1], e[2]
            if x < 1 << k:
                self.bits += "0" + (format(x, f"0{k}b") if k else "")
            else:
                w = x.bit_length() - 1
                self.bits += "1" * (w - k + 1) + "0" + format(x - (1 << w), f"0{w}b") if w else "10"


def codes(sizes):
    out, code, before = {}, 0, 0
    for size, symbol in sorted((n, s) for s, n in sizes.items()):
        code <<= size - before
        out[symbol] = format(code, f"0{size}b") if size else ""
        code, before = code + 1, size
    return out


def shown(e):
    kind = e[0]
    number, p = {
        "external": lambda: (1, itf8(e[1])), "huffman": lambda: (3, array(list(e[1])) + array(list(e[1].values()))), "length": lambda: (4, shown(e[1]) + shown(e[2])),
        "stop": lambda: (5, bytes([e[1]]) + itf8(e[2])), "beta": lambda: (6, itf8(e[1]) + itf8(e[2])), "sub": lambda: (7, itf8(e[1]) + itf8(e[2])), "gamma": lambda: (9, itf8(e[1])),
    }[kind]()
    return itf8(number) + itf8(len(p)) + p


def mapping(entries):
    body = itf8(len(entries)) + b"".join(entries)
    return itf8(len(body)) + body


#: How series are laid out: each in a block of its own; most in the core's bits; several in one block.
OWN = {k: ("external", 10 + n) for n, k in enumerate("BF CF RI RL AP RG MF NS NP TS NF TL FN FC FP DL BA QS BS RS PD HC MQ".split())}
OWN |= {"RN": ("stop", 0, 50), "IN": ("stop", 0, 51), "SC": ("length", ("external", 52), ("external", 53)), "BB": ("stop", 0, 54), "QQ": ("stop", 255, 55)}
CORE = OWN | {
    "BF": ("huffman", {0: 1, 4: 2, 16: 2}), "CF": ("huffman", {1: 0}), "RG": ("huffman", {-1: 0}), "TL": ("beta", 0, 1), "AP": ("sub", 3, 4), "RL": ("gamma", 1), "FN": ("gamma", 1), "FP": ("beta", 1, 14), "DL": ("sub", 0, 0),
    "FC": ("huffman", {ord(c): 4 for c in "XDIiNSPHBbQ"}), "MQ": ("beta", 0, 8), "IN": ("length", ("beta", 0, 9), ("huffman", {65: 1, 67: 2, 71: 3, 84: 3})), "BS": ("beta", 0, 2),
}
SHARED = OWN | dict.fromkeys("RL AP FN FP DL RG MQ TS".split(), ("external", 7)) | dict.fromkeys(("FC", "QS", "BS", "BA"), ("external", 8))
LAYOUTS = [OWN, CORE, SHARED]
MANY = -2


def features(ops, r, unknown):
    """(code, place, values) of a read's operations, and its length."""
    out, at = [], 1
    for n, op in ops:
        letters = bytes(r.choices(b"ACGT", k=n))
        if op == "X":
            out += [("X", at + k, {"BS": r.randrange(4)}) for k in range(n)]
        elif op == "I":
            out.append(("i", at, {"BA": letters[0]}) if n == 1 and r.random() < 0.7 else ("I", at, {"IN": letters}))
        elif op == "S":
            out.append(("S", at, {"SC": letters}))
        elif op in "DNPH":
            out.append((op, at, {{"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[op]: n}))
        elif op == "M" and r.random() < unknown:
            out.append(("b", at, {"BB": letters}) if r.random() < 0.5 else ("B", at, {"BA": letters[0], "QS": 30}))
            out += [("Q", at, {"QS": 20})] * (out[-1][0] == "B")
        at += n * (op in "MIS=X")
    return out, at - 1


def cram_file(path, contigs, reads, layout=0, per_slice=40, slices=2, names=True, delta=True, many=False, unknown=0.2, seed=1):
    """Reads (ref, start from 0, mapq, ops, flag) in order."""
    r = random.Random(seed)
    text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)
    raw = struct.pack("<i", len(text)) + text.encode()
    out = b"CRAM\3\0" + bytes(20) + container(0, 0, 0, 0, [block(cram.FILE_HEADER, 0, raw, 1)], [0])[0]
    reads, lines = sorted(reads, key=lambda x: x[:2]), []
    groups = [reads] if many else [list(g) for _, g in groupby(reads, key=lambda x: x[0])]
    encodings = LAYOUTS[layout]
    tag = int.from_bytes(b"XAC", "big")
    for own in groups:
        for k in range(0, len(own), per_slice * slices):
            header = mapping([b"RN" + bytes([names]), b"AP" + bytes([delta]), b"RR\0", b"SM" + bytes(5), b"TD" + itf8(5) + b"\0XAC\0"])
            head = block(cram.COMPRESSION, 0, header + mapping([key.encode() + shown(e) for key, e in encodings.items()]) + mapping([itf8(tag) + shown(("length", ("huffman", {1: 0}), ("external", 60)))]), 1)
            blocks, places, sizes, spans, n = [head], [], [], [], 0
            for j in range(k, min(k + per_slice * slices, len(own)), per_slice):
                part = own[j : j + per_slice]
                n += len(part)
                end = max(s + sum(x for x, op in ops if op in "MDN=X") for _, s, _, ops, *_ in part)
                first = part[0][1] + 1
                w, at = Writer(encodings), first
                for ref, start, mapq, ops, *flag in part:
                    flag = flag[0] if flag else 0
                    found, length = features(ops, r, unknown)
                    tagged = r.randrange(2)
                    w.put("BF", flag), w.put("CF", 1)
                    if many:
                        w.put("RI", ref)
                    w.put("RL", length), w.put("AP", start + 1 - at if delta else start + 1), w.put("RG", -1)
                    at = start + 1
                    if names:
                        w.put("RN", b"read")
                    w.put("TL", tagged)
                    if tagged:
                        w._put(("external", 60), 5, True)
                    if flag & 4:
                        for _ in range(length):
                            w.put("BA", 65)
                    else:
                        w.put("FN", len(found))
                        before = 0
                        for code, place, values in found:
                            w.put("FC", ord(code)), w.put("FP", place - before)
                            before = place
                            for key, v in values.items():
                                w.put(key, v)
                        w.put("MQ", mapq)
                    for _ in range(length):
                        w.put("QS", 40)
                bits = w.bits + "0" * (-len(w.bits) % 8)
                core = int(bits or "0", 2).to_bytes(len(bits) // 8, "big")
                data = [block(cram.CORE, 0, core, j // per_slice % 4)] + [block(cram.EXTERNAL, i, x, r.randrange(len(METHODS))) for i, x in w.streams.items()]
                ref = MANY if many else part[0][0]
                slice_head = itf8(ref) + itf8(first) + itf8(end - first + 1) + itf8(len(part)) + ltf8(j) + itf8(len(data)) + array([0] + list(w.streams)) + itf8(-1) + bytes(16)
                data = [block(cram.SLICE, 0, slice_head)] + data
                places.append(sum(map(len, blocks)))
                sizes.append(sum(map(len, data)))
                blocks += data
                spans.append([(ref, min(x[1] for x in g) + 1, max(x[1] + sum(n for n, op in x[3] if op in "MDN=X") for x in g)) for ref, g in ((ref, [x for x in part if x[0] == ref]) for ref in sorted({x[0] for x in part}))])
            made, _ = container(MANY if many else own[0][0], 1, 1, n, blocks, places, k)
            lines += [f"{ref}\t{st}\t{end - st + 1}\t{len(out)}\t{at}\t{size}" for at, size, own_spans in zip(places, sizes, spans) for ref, st, end in own_spans]
            out += made
    path.write_bytes(out + container(-1, 4542278, 0, 0, [block(cram.COMPRESSION, 0, b"\1\0\1\0\1\0")], [])[0])
    path.with_name(path.name + ".crai").write_bytes(gzip.compress("\n".join(lines).encode() + b"\n"))
    return str(path)


def some_reads(seed, n=150):
    r, out = random.Random(seed), []
    for ref, length in ((0, 40_000), (1, 3_000_000)):
        for start in sorted(r.randrange(length - 3000) for _ in range(n)):
            middle = [(r.randint(1, 300), r.choice("MMM=XIDNP")) for _ in range(r.randint(0, 6))]
            ops = [(9, "H")] * (r.random() < 0.1) + [(r.randint(1, 20), "S")] * (r.random() < 0.3) + [(r.randint(1, 90), "M"), *middle, (r.randint(1, 5), "M")] + [(r.randint(1, 20), "S")] * (r.random() < 0.3)
            out.append((ref, start, r.randint(0, 60), ops, r.choice([0, 0, 16])))
        out.append((ref, 30_000, 0, [(10, "M")], 4))
    return out


CONTIGS = [("ctg", 40_000), ("big", 3_000_000), ("none", 10)]


def row(read, differences=False):
    ref, start, mapq, ops, _ = read
    letter = (lambda op: {"M": "="}.get(op, op)) if differences else lambda op: "M" if op in "=X" else op
    cigar = "".join(f"{sum(n for n, _ in g)}{op}" for op, g in groupby([(n, letter(op)) for n, op in ops], lambda x: x[1]))
    return CONTIGS[ref][0], start + 1, cigar, mapq


def test_numbers():
    for n in [0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1, 1 << 28, (1 << 31) - 1, -1, -5]:
        assert cram.Bytes(itf8(n)).itf8() == n
    for n in [0, 127, 128, 1 << 20, 1 << 35, 1 << 48, (1 << 56) - 1, 1 << 56, (1 << 63) - 1]:
        assert cram.Bytes(ltf8(n)).ltf8() == n


@pytest.mark.parametrize("order", [0, 1])
def test_rans(order):
    r = random.Random(order)
    for k in [0, 1, 2, 3, 4, 5, 7, 8, 100, 1001, 4000]:
        for letters in (b"\0", b"ab", bytes(range(7, 30)), bytes(range(256))):
            data = bytes(r.choices(letters, weights=[1.3**-i for i in range(len(letters))], k=k))
            assert cram.rans(rans(data, order)) == data


@pytest.mark.parametrize("layout,names,delta,many", [(0, True, True, False), (1, True, True, False), (2, False, True, False), (0, False, False, True), (2, True, False, True)])
def test_cram(spark, tmp_path, layout, names, delta, many):
    reads = some_reads(layout)
    path = cram_file(tmp_path / "x.cram", CONTIGS, reads, layout, names=names, delta=delta, many=many)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = sorted(row(x) for x in reads if not x[4] & 4)
    assert rows(read_alignments(spark, path)) == want == rows(read_alignments(spark, "file://" + path))
    assert rows(read_alignments(spark, path).filter("chrom = 'big' and start between 1000000 and 1200000")) == [x for x in want if x[0] == "big" and 1_000_000 <= x[1] <= 1_200_000]
    for some in ([("big", 100_000, 200_000)], [("ctg", 1, 50), ("ctg", 20_000, 20_010), ("big", 2_000_000, 2_000_000)], [("none", 1, 5)]):
        hit = [x for x in want if any(x[0] == c and x[1] <= b and x[1] + cram.reference_span(x[2]) - 1 >= a for c, a, b in some)]
        assert rows(read_alignments(spark, path, some)) == hit
    assert [tuple(x) for x in bam_contigs(spark, path).collect()] == CONTIGS
    path = cram_file(tmp_path / "y.cram", CONTIGS, reads, layout, names=names, delta=delta, many=many, unknown=0)
    reader = cram.CramReader({"path": path, "differences": "true"})
    assert sorted(x for p in reader.partitions() for x in reader.rows(p)) == sorted(row(x, True) for x in reads if not x[4] & 4)


def test_only_what_is_needed_is_decoded(tmp_path):
    """Qualities, names and tags in blocks of their own are passed over; slices beyond a region aren't read."""
    for layout, apart in ((0, True), (2, False)):
        reads = some_reads(5)
        path = cram_file(tmp_path / f"{layout}.cram", CONTIGS, reads, layout)
        f = open(path, "rb").read()
        reader = cram.CramReader({"path": path})
        part = reader.partitions()[0]
        b = cram.Bytes(f, part.container)
        cram.container_head(b)
        layout = cram.Layout(cram.Block(b).data())
        assert ({"RN", "QS", "BS", "BA", "QQ"} & layout.read == set()) is apart and not layout.read & {*layout.tags}
    few = cram.CramReader({"path": path, "regions": '{"big": [[5, 9000]]}'})
    assert sum(len(p.slices) for p in few.partitions()) < sum(len(p.slices) for p in reader.partitions()) / 3


def test_cram_calls_and_errors(spark, tmp_path):
    """The same calls as from a BAM file of the same reads; a slice that can't be read is named."""
    from .test_core import bam_file

    reads = [(0, s, 60, [(50, "M")], 0) for s in [*range(0, 15_000, 2), *range(20_000, 39_000, 2)]]
    path, other = cram_file(tmp_path / "a.cram", CONTIGS, reads, 1, per_slice=500), bam_file(tmp_path / "a.bam", CONTIGS, reads, per_block=100)
    (tmp_path / "r.bed").write_text("ctg\t100\t30000\nctg\t35000\t36000\n")
    bed = str(tmp_path / "r.bed")
    a, b = api.call_file(spark, path, bed=bed), api.call_file(spark, other, bed=bed)
    assert sorted(map(str, a.regions.collect())) == sorted(map(str, b.regions.collect())) and a.errors.count() == 0
    assert a.pileup.exceptAll(b.pileup).count() == b.pileup.exceptAll(a.pileup).count() == 0
    raw = bytearray((tmp_path / "a.cram").read_bytes())
    raw[-2000] ^= 255
    (tmp_path / "a.cram").write_bytes(raw)
    calls = api.call_file(spark, path, bed=bed)
    assert {x.chromStart for x in calls.regions.collect()} and calls.errors.count() == 0
    (tmp_path / "r.bed").write_text("ctg\t100\t14000\nctg\t38000\t39000\n")
    calls = api.call_file(spark, path, bed=bed)
    assert [(x.st, "checksum" in x.error) for x in calls.errors.collect()] == [(38000, True)] and {x.chromStart for x in calls.regions.collect()} >= {100}
    for bad, why in ((b"BAM\1" + bytes(30), "not a CRAM"), (b"CRAM\2\1" + bytes(30), "CRAM 2")):
        (tmp_path / "b.cram").write_bytes(bad)
        with pytest.raises(ValueError, match=why):
            bam_contigs(spark, str(tmp_path / "b.cram"))
    with pytest.raises(ValueError, match="codec 5"):
        head = bytes([5, 4]) + itf8(1) + itf8(2) + itf8(2) + b"ab"
        cram.Block(cram.Bytes(head + struct.pack("<I", zlib.crc32(head)))).data()
