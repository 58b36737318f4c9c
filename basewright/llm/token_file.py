"""Token ids as shard files with a minimal perfect hash index.

``write`` deals documents out by ranges of their id, so shards follow each other
in ascending id order; a task writes its documents to one shard after another, each closed at
``SHARD_DOCS`` documents or ``SHARD_TOKENS`` ids:

    payload  raw little-endian ids, written as they come
    index    levels of the minimal perfect hash function, then for each slot the
             fingerprint, start and length of a document
    keys     document ids in order, each with how many equal ids came before it in the shard
    tail     width of an id (2 or 4) and lengths of what stands before, its own length, magic ``BWTK2``

The hash function is built in levels: keys hash into a bit array, those alone at
their bit are placed, the others go to the next level.  A key's slot is the
number of set bits before its own, so a lookup costs a few probes; the stored
64-bit fingerprint refuses a foreign key.  Files get their final name's content
once, under a name with the task attempt; only files that the manifest table
names count, so lost or repeated tasks leave nothing behind that is read.

Cases: null and empty texts hold the end id only; a null document id sorts last
and has a key of its own; repeated ids follow each other by text hash and stay apart by their occurrence
number; a text of any length is one document of its shard, whose ids alone are in memory; columns other
than id and text aren't read; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LibraryBpe, coder, default_path
from .common import at_rest, dealt_in_order, fresh, opened, shuffle_partitions, small_batches, text_hash, written

MAGIC = b"BWTK2"
END_ID = 1
GAMMA = 2
#: A shard is closed at so many documents or ids.
SHARD_DOCS, SHARD_TOKENS = 1 << 17, 1 << 27
#: Documents encoded, and ids read, at a time.
SLICE, READ_TOKENS = 256, 1 << 20
MANIFEST = "task int, part int, path string, n_docs long, n_tokens long, low long, high long, has_null boolean"


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def key_of(ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """One 64-bit key for a document id and its occurrence; distinct for nth < 2**16 but for hash collisions, which ``PerfectHash`` refuses."""
    return mix(mix(ids.astype("u8"), 101) ^ (nth.astype("u8") << np.uint64(1) | null.astype("u8")), 102)


class PerfectHash:
    """Minimal perfect hash function over distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.cumsum(np.concatenate([[0], x])) for x in levels]
        ends = np.cumsum([0] + [int(c[-1]) for c in counts])
        self.before = [c + e for c, e in zip(counts, ends)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            if len(levels) > 60:
                raise ValueError("two documents have the same key")
            at = mix(keys, len(levels)) % np.uint64(GAMMA * len(keys))
            hits = np.bincount(at.astype("i8"), minlength=GAMMA * len(keys))
            levels.append((hits == 1).astype("u1"))
            keys = keys[hits[at.astype("i8")] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has it."""
        out, todo = np.full(len(keys), -1), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[todo], k) % np.uint64(len(bits))).astype("i8")
            here = bits[at] == 1
            out[todo[here]] = self.before[k][at[here]]
            todo = todo[~here]
        return out


class ShardWriter:
    """One shard file under way: ids go to the file at once, the index at the end."""

    def __init__(self, f, width: int):
        self.f, self.width, self.ids, self.nth, self.sizes, self.total, self.seen = f, width, [], [], [], 0, {}

    def add(self, doc_id: int | None, payload: bytes) -> None:
        self.f.write(payload)
        n = len(payload) // self.width
        self.ids.append(doc_id)
        self.nth.append(self.seen.get(doc_id, 0))
        self.seen[doc_id] = self.nth[-1] + 1
        self.sizes.append(n)
        self.total += n

    def close(self) -> None:
        null = np.array([x is None for x in self.ids], bool)
        ids, nth = np.array([x or 0 for x in self.ids], "i8"), np.array(self.nth, "u8")
        keys = key_of(ids, null, nth)
        mph = PerfectHash.build(keys)
        slots = mph.slots(keys)
        n = np.array(self.sizes, "u8")
        table = np.zeros(len(keys), dtype=TABLE)
        table["fingerprint"][slots], table["start"][slots], table["n"][slots] = mix(keys, 200), np.cumsum(n) - n, n
        for x in mph.levels:
            self.f.write(np.packbits(x).tobytes())
        self.f.write(table.tobytes())
        self.f.write(np.rec.fromarrays([ids, nth | null.astype("u8") << np.uint64(63)], dtype=KEYS).tobytes())
        tail = json.dumps({"width": self.width, "tokens": self.total, "docs": len(keys), "levels": [len(x) for x in mph.levels]}).encode()
        self.f.write(tail + struct.pack("<I", len(tail)) + MAGIC)


TABLE, KEYS = [("fingerprint", "<u8"), ("start", "<u8"), ("n", "<u8")], [("id", "<i8"), ("nth", "<u8")]


class Shard:
    """A shard file opened for keyed access: the index is read once, ids by range."""

    def __init__(self, f):
        self.f, end = f, f.size()
        f.seek(end - 9)
        size, magic = struct.unpack("<I5s", f.read(9))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        f.seek(end - 9 - size)
        head = json.loads(f.read(size))
        self.width = head["width"]
        f.seek(self.width * head["tokens"])
        self.hash = PerfectHash([np.unpackbits(np.frombuffer(f.read((n + 7) // 8), "u1"))[:n] for n in head["levels"]])
        self.table = np.frombuffer(f.read(24 * head["docs"]), TABLE)
        self.keys = np.frombuffer(f.read(16 * head["docs"]), KEYS)

    def all_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        null = self.keys["nth"] >> np.uint64(63)
        return self.keys["id"], null.astype(bool), self.keys["nth"] & np.uint64((1 << 63) - 1)

    def find(self, ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is here, where its ids start and how many there are."""
        keys = key_of(ids, null, nth)
        slots = self.hash.slots(keys)
        if not len(self.table):
            return np.zeros(len(keys), bool), slots, slots
        rows = self.table[slots]
        return (slots >= 0) & (rows["fingerprint"] == mix(keys, 200)), rows["start"], rows["n"]

    def occurrences(self, doc_id: int | None) -> int:
        """How many documents of the shard have this id: the first occurrence number that isn't there."""
        has = lambda nth: bool(self.find(np.array([doc_id or 0], "i8"), np.array([doc_id is None]), np.array([nth], "u8"))[0][0])
        low, high = 0, 1
        while has(high - 1):
            low, high = high, 2 * high
        while low < high - 1:
            mid = (low + high) // 2
            low, high = (mid, high) if has(mid - 1) else (low, mid)
        return low

    def checksums(self, start: np.ndarray, n: np.ndarray) -> list[int]:
        """crc32 of the ids (as 4 bytes each) of the documents at these places, neighbours read together."""
        out, i = [], 0
        while i < len(start):
            j, end = i + 1, int(start[i]) + int(n[i])
            while j < len(start) and int(start[j]) == end and end - int(start[i]) < READ_TOKENS:
                end += int(n[j])
                j += 1
            base = int(start[i])
            self.f.seek(self.width * base)
            ids = np.frombuffer(self.f.read(self.width * (end - base)), f"<u{self.width}").astype("<u4")
            out += [zlib.crc32(ids[int(s) - base : int(s) - base + int(k)]) for s, k in zip(start[i:j], n[i:j])]
            i = j
        return out


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """Writes every document's ids and the end id in ascending order of the (integer) id.

    Texts are encoded where they are read; only ids are shuffled.
    Returns the manifest: shard, path, n_docs, n_tokens, low and high id, has_null.
    """
    spark, path = docs.sparkSession, path or default_path()
    folder = fresh(spark, "tokens")
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("tie"), F.col(text_col).alias("text"))
    task, n = dealt_in_order(rows, "id", "tie", tasks or shuffle_partitions(spark))

    def encode(batches):
        c = coder(path, LibraryBpe)
        kind, end = "<u2" if c.n_ids <= 1 << 16 else "<u4", c.packed([end_id])
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            made = [np.frombuffer(c.encode_bytes(x.as_py()) + end, "<u4").astype(kind).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["id", "tie", "ids"])
        at_rest()

    ids = rows.select("id", "tie", "text").mapInArrow(encode, "id long, tie long, ids binary")
    dealt = ids.withColumn("task", task).repartitionById(n, "task").sortWithinPartitions("task", F.col("id").asc_nulls_last(), "tie").select("task", "id", "ids")

    def run(batches):
        from contextlib import ExitStack

        from pyspark import TaskContext

        attempt, width = TaskContext.get().taskAttemptId(), 2 if coder(path, LibraryBpe).n_ids <= 1 << 16 else 4
        now, part, to, shard, held = None, 0, None, None, ExitStack()

        def close():
            shard.close()
            held.close()
            known = [x for x in shard.ids if x is not None]
            rows = [[now], [part], [to], [len(shard.ids)], [shard.total], [min(known, default=None)], [max(known, default=None)], [len(known) < len(shard.ids)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()])], names=["task", "part", "path", "n_docs", "n_tokens", "low", "high", "has_null"])

        with held:
            for b in batches:
                for task, i, ids in zip(*(b.column(k) for k in range(3))):
                    task = task.as_py()
                    if shard and (task != now or len(shard.ids) >= SHARD_DOCS or shard.total >= SHARD_TOKENS):
                        yield close()
                        part, shard = part + 1 if task == now else 0, None
                    if not shard:
                        now, to = task, f"{folder}/shard-{task:06d}-{part:04d}-{attempt}.bin"
                        shard = ShardWriter(held.enter_context(opened(to, "w")), width)
                    shard.add(i.as_py(), ids.as_py())
            if shard:
                yield close()

    return written(dealt.mapInArrow(run, MANIFEST), "manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's number and its first token's place; one row a shard, so one window holds them."""
    order = Window.orderBy("task", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumns({"shard": F.row_number().over(order), "base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0))})


def read_all(manifest: DataFrame) -> DataFrame:
    """Every document from the files, by its key: doc_id, start (in the whole), n_tokens, ids_crc32."""
    return _from_shards(starts(manifest).select("path", "base", "shard").repartitionById(max(1, manifest.count()), F.col("shard") - 1), None)


def lookup(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that ``keys`` names, as for read_all; absent keys give no row.

    A key goes to the shards whose range holds it, found by bisection in the list of shards (the driver's: one
    row a shard), then one probe of the hash function finds its slot.
    """
    shards = starts(manifest).orderBy("shard").collect()
    known = [r for r in shards if r["low"] is not None]
    lows, highs, nulls = np.array([r["low"] for r in known], "i8"), np.array([r["high"] for r in known], "i8"), [r for r in shards if r["has_null"]]
    places, null_places = [(r["path"], r["base"], r["shard"]) for r in known], [(r["path"], r["base"], r["shard"]) for r in nulls]

    def route(batches):
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                # shards ascend, so those that hold an id are neighbours
                here = null_places if i is None else places[np.searchsorted(highs, i) : np.searchsorted(lows, i, "right")]
                out += [(*x, i) for x in here]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, [pa.string(), pa.int64(), pa.int32(), pa.int64()])], names=["path", "base", "shard", "id"])

    keys = keys.select(F.col(id_col).cast("long").alias("id")).distinct()
    return _from_shards(keys.mapInArrow(route, "path string, base long, shard int, id long").repartition("shard").sortWithinPartitions("shard"), "id")


def _from_shards(rows: DataFrame, key: str | None) -> DataFrame:
    def run(batches):
        shard = name = held = None
        try:
            for b in batches:
                for r in b.to_pylist():
                    if r["path"] != name:
                        if held:
                            held.__exit__(None, None, None)
                        name, held = r["path"], opened(r["path"], "r")
                        shard = Shard(held.__enter__())
                    if key:
                        n = shard.occurrences(r[key])
                        ids, null, nth = np.full(n, r[key] or 0, "i8"), np.full(n, r[key] is None), np.arange(n, dtype="u8")
                    else:
                        ids, null, nth = shard.all_keys()
                    if not len(ids):
                        continue
                    found, start, n = shard.find(ids, null, nth)
                    if not found.all():
                        raise ValueError(f"{name}: the index lacks a key that the file holds")
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array(start.astype("i8") + r["base"]), pa.array(n.astype("i8")), pa.array(shard.checksums(start, n), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        finally:
            if held:
                held.__exit__(None, None, None)

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
