"""WARC archives with a two-level capture index.

``write`` turns each page into one WARC/1.1 record (a gzip member of its own) and
leaves archives in the shared folder, one file a task.  Of records with equal
payloads of at least ``REVISIT_BYTES``, that with the largest page id is a
``response``; the others are ``revisit`` records of the identical-payload-digest
profile: the HTTP header block with the payload's length, no payload, and a
reference to the response.  Smaller payloads are always stored.

``index`` sorts the captures by reversed-host URL key and page id and writes them in
compressed blocks, one index file a task, each with the sparse directory of its blocks (first key and place
of each) at its end; the table it returns has one row a file (first and last key).
``fetch`` takes keys: bisection in the list of files, then in a file's directory, then in the one
block that can hold the key, which is read by range; the records follow by range reads, those of one archive
in its order.  ``lookup`` does so for URLs.

Files carry the task attempt in their name and only those that the written
capture and directory tables name are read, so repeated tasks do no harm.

Cases: a null html is an empty payload; a null page id can't be referred to, so a
group of equal payloads without any id is all responses; rows with the same id
and payload are both responses if that id is the largest; repeated rows have records of their own with ids of
their own; a null URL has an empty key; white space in a URL counts as ``%20``; URLs and payloads of any length
are kept whole; columns other than id, URL and html aren't read; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, opened, shuffle_partitions, small_batches, spread_join, written

REVISIT_BYTES = 1000
BLOCK_LINES = 256
LEVEL = 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, type string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query``: hosts that share a suffix sort together; white space is ``%20``."""
    scheme, mark, rest = (url or "").partition("://")
    rest = rest if mark else scheme
    m = re.match(r"([^/?#]*)(.*)", rest, re.S)
    host, tail = m[1].lower().split("@")[-1], m[2].partition("#")[0]
    host, colon, port = host.partition(":")
    return re.sub(r"\s", "%20", ",".join(reversed(host.split("."))) + (colon + port) + ")" + tail)


def one_line(url: str | None) -> str:
    return re.sub(r"[\r\n]", " ", url or "")


def record(name: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None = None) -> bytes:
    """One gzipped record with an id made of ``name``; digest is bare hex, refers_to the response's page id of a revisit."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest())}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}", f"Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {one_line(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"Refers-To-Page-ID: {refers_to}"]
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + gz.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of a gzipped record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode().split("\r\n")[1:])
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), payload


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives; returns the table of captures (key, page_id, type, file, offset, length)."""
    folder = fresh(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    equal = rows.filter(large).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n")).select("digest", F.col("kept.page_id").alias("keep"), F.col("kept.url").alias("keep_url"), "n").filter("n > 1 and keep is not null")
    kept = spread_join(rows, written(equal, "equal-payloads"), ["digest"], "n", F.xxhash64("page_id", "url"))
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    plan = kept.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), "keep_url")

    def run(batches):
        from pyspark import TaskContext

        to = f"{folder}/part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz"
        batches = iter(batches)
        if (first := next(batches, None)) is None:
            return
        with opened(to, "w") as f:
            at = 0
            while first is not None:
                rows = [[], [], [], [], [], []]
                for page_id, url, body, digest, refers_to, refers_url in zip(*(first.column(k) for k in range(6))):
                    page_id, url, refers_to = page_id.as_py(), url.as_py(), refers_to.as_py()
                    member = record(f"{to} {at}", page_id, url, body.as_py(), digest.as_py(), refers_to, refers_url.as_py())
                    f.write(member)
                    for x, v in zip(rows, (url_key(url), page_id, "response" if refers_to is None else "revisit", to, at, len(member))):
                        x.append(v)
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, KINDS)], names=NAMES)
                first = next(batches, None)

    return written(plan.mapInArrow(run, CAPTURE), "captures")


NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def pack_lines(rows: list[tuple]) -> bytes:
    text = "\n".join(" ".join([r[0], "-" if r[1] is None else str(r[1]), r[2], str(r[4]), str(r[5]), r[3]]) for r in rows)
    return zlib.compress(text.encode(), 6)


def unpack_lines(block: bytes) -> list[tuple]:
    out = []
    for line in zlib.decompress(block).decode().split("\n"):
        key, page_id, kind, offset, length, file = line.split(" ", 5)
        out.append((key, None if page_id == "-" else int(page_id), kind, file, int(offset), int(length)))
    return out


#: Before and behind every page id, null among them.
LOW, HIGH = -(1 << 63) - 1, 1 << 63


def place(key: str, page_id: int | None) -> tuple[str, int]:
    """What the index is sorted by; a null page id comes first, as Spark sorts it."""
    return key, LOW if page_id is None else page_id


def index(captures: DataFrame) -> DataFrame:
    """Writes the sorted, compressed blocks with their directories; returns one row a file (path, first_key, first_id, last_key, last_id)."""
    spark = captures.sparkSession
    folder = fresh(spark, "capture-index")
    order = ["key", "page_id", "file", "offset"]  # places are unique, so no key can fill a task beyond its share
    dealt = captures.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        to = f"{folder}/blocks-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.cdx"
        held, at, directory, last = [], 0, [], None

        def flush(f, rows):
            nonlocal at
            block = pack_lines(rows)
            f.write(block)
            directory.append((*place(*rows[0][:2]), at, len(block)))
            at += len(block)

        batches = iter(batches)
        if (first := next(batches, None)) is None:
            return
        with opened(to, "w") as f:
            while first is not None:
                held += zip(*(first.column(k).to_pylist() for k in range(6)))
                last = held[-1] if held else last
                while len(held) >= BLOCK_LINES:
                    flush(f, held[:BLOCK_LINES])
                    held = held[BLOCK_LINES:]
                first = next(batches, None)
            if held:
                flush(f, held)
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            f.write(tail + struct.pack("<I", len(tail)))
        if directory:
            key, first_id = directory[0][:2]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((to, key, None if first_id == LOW else first_id, last[0], last[1]), FILE_KINDS)], names=FILE_NAMES)

    return written(dealt.mapInArrow(run, FILES), "index-files")


FILES = "path string, first_key string, first_id long, last_key string, last_id long"
FILE_NAMES, FILE_KINDS = [x.split()[0] for x in FILES.split(", ")], [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]


class IndexFile:
    """One index file: its directory is read once, blocks by range, the last one kept."""

    def __init__(self, f):
        self.f, end = f, f.size()
        f.seek(end - 4)
        size = struct.unpack("<I", f.read(4))[0]
        f.seek(end - 4 - size)
        self.directory = json.loads(zlib.decompress(f.read(size)))
        self.firsts = [(x[0], x[1]) for x in self.directory]
        self.at, self.rows, self.places = None, [], []

    def block(self, k: int) -> None:
        if k != self.at:
            self.f.seek(self.directory[k][2])
            self.at, self.rows = k, unpack_lines(self.f.read(self.directory[k][3]))
            self.places = [place(*x[:2]) for x in self.rows]

    def find(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[tuple]:
        """The captures from one place to another, both included."""
        for k in range(max(0, bisect.bisect_left(self.firsts, low) - 1), bisect.bisect_right(self.firsts, high)):
            self.block(k)
            yield from self.rows[bisect.bisect_left(self.places, low) : bisect.bisect_right(self.places, high)]


def fetch(directory: DataFrame, wanted: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the distinct rows (key, page_id) of ``wanted``; with (key) alone those of any page id."""
    files = sorted(((place(r["first_key"], r["first_id"]), place(r["last_key"], r["last_id"]), r["path"]) for r in directory.collect()))  # one row a file
    firsts, lasts, paths = [x[0] for x in files], [x[1] for x in files], [x[2] for x in files]
    exact = "page_id" in wanted.columns

    def route(batches):
        for b in batches:
            out = []
            for key, page_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist() if exact else [None] * b.num_rows):
                low, high = (place(key, page_id), place(key, page_id)) if exact else ((key, LOW), (key, HIGH))
                out += [(paths[k], key, page_id) for k in range(bisect.bisect_left(lasts, low), bisect.bisect_right(firsts, high))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, [pa.string(), pa.string(), pa.int64()])], names=["path", "key", "page_id"])

    def search(batches):
        name = held = own = None
        try:
            for b in batches:
                out = []
                for path, key, page_id in zip(*(b.column(k).to_pylist() for k in range(3))):
                    if path != name:
                        if held:
                            held.__exit__(None, None, None)
                        name, held = path, opened(path, "r")
                        own = IndexFile(held.__enter__())
                    out += own.find(place(key, page_id), place(key, page_id)) if exact else own.find((key, LOW), (key, HIGH))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), KINDS)], names=NAMES)
        finally:
            if held:
                held.__exit__(None, None, None)

    n = shuffle_partitions(directory.sparkSession)
    routed = wanted.select("key", *["page_id"] * exact).distinct().mapInArrow(route, "path string, key string, page_id long")
    entries = routed.repartition(n, "path").sortWithinPartitions("path", "key", "page_id").mapInArrow(search, CAPTURE)
    return _records(entries.repartition(n, "file").sortWithinPartitions("file", "offset"), payloads)


def _records(entries: DataFrame, payloads: bool = False) -> DataFrame:
    """Each entry's record, read by range from its archive and checked against its digest."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads
    number = lambda x: int(x) if x else None

    def run(batches):
        name = held = f = None
        try:
            for b in batches:
                out = []
                for file, offset, length in zip(*(b.column(k).to_pylist() for k in range(3))):
                    if file != name:
                        if held:
                            held.__exit__(None, None, None)
                        name, held = file, opened(file, "r")
                        f = held.__enter__()
                    f.seek(offset)
                    warc, http, payload = parse(f.read(length))
                    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if warc["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"{file} at {offset}: the payload doesn't match its record")
                    row = (number(warc["page-id"]), int(http["content-length"]), digest, warc["warc-type"], number(warc.get("refers-to-page-id")), warc["warc-target-uri"])
                    out.append((*row, payload) if payloads else row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
        finally:
            if held:
                held.__exit__(None, None, None)

    return entries.select("file", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads)


def lookup(directory: DataFrame, urls: list[str], payloads: bool = True) -> DataFrame:
    """The records of some URLs."""
    keys = sorted({url_key(u) for u in urls})
    return fetch(directory, directory.sparkSession.createDataFrame([(k,) for k in keys], "key string"), payloads)
