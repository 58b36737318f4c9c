"""Prefix trie of conversations as a Cartesian tree over the LCP array of the sorted conversations.

A conversation is the sequence of its turns (role, text); every different sequence of first d turns is a node of depth d.  A turn
counts as 128 bits of its sha256 and its UTF-8 length, so a conversation is a key of 16 bytes a turn and sorts with all that share its first turns.
With L the number of turns that neighbours of that order share, a node of depth d is a run of conversations between nearest values of L below d.

Conversations are dealt out by ranges of (key, id) into blocks of bounded size, each sorted; equal ones may lie in several blocks.  In its block a
task finds the runs with a stack: nodes of equal L are one run, a run stands for all depths between its parent's and its own,
and its figures are sums, minima and differences of running sums.  A run that reaches an end of its block is a piece of a node.
The blocks' minima of L (one row a block) then say for each piece, by halving, in which block its nearest smaller value on the left
lies, all pieces at once; pieces with the same start and depth are one node, and a grouped sum makes it whole.  Nothing but a few numbers of
each block goes through the driver.

Figures of a node: conv_id, its smallest member; n_convs; n_children; n_leaves; saved_tokens, the bytes that storing each turn once saves in its
subtree; ends_sha256 over the ids of the conversations that end there.  That hash runs over the joined ids in order, so for a node over several blocks one
task reads them, as pieces of up to CHUNK bytes and never held together.

Cases: turns are ordered by number (null first), then role, then text's hash; null roles and texts are empty; rows without a conversation's id
are left out, as they belong to none; a conversation without turns ends at the root; equal conversations are one path; a
conversation of any length is one row of 24 bytes a turn; other columns aren't read; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, at_rest, shuffle_partitions, small_batches, spread_join

TURN = 16
#: Turns in a block, about.
BLOCK_TURNS = 1 << 20
#: Bytes of ids that a row carries to the hash of a node over several blocks.
CHUNK = 1 << 20
#: Nodes that a task sends on at a time.
SLICE = 1 << 14
NONE = hashlib.sha256(b"").hexdigest()

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
#: What a block's task returns: whole nodes, pieces of nodes, ids that end at pieces, one row about the block.
WHOLE, PIECE, ENDS, BLOCK = range(4)
NUMBERS = ["kind", "block", *NODE, "head", "up_head", "tail", "below", "seq"]
OUT = ", ".join(f"{c} long" for c in NUMBERS) + ", ends_sha256 string, data binary, last binary, sums binary"


def turn_lists(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turns): each conversation's turns in order, as (hash, bytes).  Texts aren't shuffled, their hashes are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    hashed = lambda x: F.substring(F.sha2(x.cast("binary"), 256), 1, 2 * TURN)
    # a role's length tells where it ends
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), hashed(text).alias("th"), hashed(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("hash"), F.octet_length(text).cast("long").alias("bytes"))
    own = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["hash"].alias("hash"), x["bytes"].alias("bytes"))).alias("turns"))



def with_shared_starts(convs: DataFrame, of: int = 5, most: int = 8) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % ``of`` (all if fewer, none if there is no such), then its
    own turns behind its first h; h is crc32 of the decimal id modulo ``most`` + 1."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    starts = convs.filter(F.col("conv_id") % of == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("start"))
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % of).join(starts, "base", "left")
    start = F.slice(F.coalesce("start", F.slice("turns", 1, 0)), F.lit(1), h)
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(start, own).alias("turns"))


def keyed(convs: DataFrame) -> DataFrame:
    """Rows (conv_id, key, sizes) of rows (conv_id, turns): 16 bytes a turn, and the turns' lengths."""
    return convs.select("conv_id", F.unhex(F.array_join(F.col("turns.hash"), "")).alias("key"), F.col("turns.bytes").alias("sizes"))


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    return int(np.argmax(np.frombuffer(a, "u1", n) != np.frombuffer(b, "u1", n))) // TURN


def runs(lcp: list[int], length: list[int]) -> tuple[np.ndarray, ...]:
    """The runs of one block as arrays: first and last conversation, depth, the parent's depth, places of the parents among the runs, number of
    children that start behind the block's first conversation, whether the run may go on behind the block.

    lcp[j] is what conversation j shares with the one before it; lcp[0] isn't read.  The last run is the root's."""
    out: list[list] = []
    stack = [[0, -1, 0, 0, -1, 0]]  # first, last, depth, parent's depth, place of the parent, children
    kids: list[list[int]] = [[]]
    n = len(length)

    def pop(last: int, into: int) -> None:
        run, own = stack.pop(), kids.pop()
        run[1], run[3] = last, into
        for k in own:
            out[k][4] = len(out)
        out.append(run)

    for j in range(n):
        if length[j] > stack[-1][2]:
            stack.append([j, -1, length[j], 0, -1, 0])
            kids.append([])
        low = lcp[j + 1] if j + 1 < n else -1
        while low >= 0 and stack[-1][2] > low:
            first, into = stack[-1][0], max(low, stack[-2][2])
            pop(j, into)
            if stack[-1][2] < low:
                stack.append([first, -1, low, 0, -1, 0])
                kids.append([])
            kids[-1].append(len(out) - 1)
            stack[-1][5] += first > 0
    closed = len(out)
    while stack:
        first, into = stack[-1][0], stack[-2][2] if len(stack) > 1 else -1
        pop(n - 1, into)
        if stack:
            kids[-1].append(len(out) - 1)
            stack[-1][5] += first > 0
    a = np.array(out, "i8").reshape(-1, 6)
    return (*(a[:, k] for k in range(6)), np.arange(len(out)) >= closed)


def block_rows(block: int, ids: np.ndarray, keys: list[bytes], sizes: list[np.ndarray]):
    """What one sorted block has to say: dictionaries of columns, each a slice of bounded length."""
    n = len(ids)
    length = [len(k) // TURN for k in keys]
    lcp = [0] + [shared_turns(a, b) for a, b in zip(keys, keys[1:])]
    first, last, depth, above, up, kids, tail = runs(lcp, length)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in sizes]
    size, shared = np.array(length), np.array(lcp)
    # conversations that nothing longer or equal follows; the block's last one is settled later
    leaf = np.concatenate([[0], np.cumsum(np.append(shared[1:] < size[:-1], False))])
    saved = np.cumsum([int(s[k]) if j else 0 for j, (s, k) in enumerate(zip(sums, lcp))])
    least = np.empty(len(first), "i8")
    for r in range(len(first)):  # children come before their parents
        least[r] = ids[first[r] : last[r] + 1].min() if last[r] - first[r] < 64 else -1
    wide = np.flatnonzero(last - first >= 64)
    if len(wide):
        table = [ids]
        while 2 << len(table) - 1 <= n:
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        for r in wide:
            k = int(last[r] - first[r] + 1).bit_length() - 1
            least[r] = min(table[k][first[r]], table[k][last[r] + 1 - (1 << k)])
    same = np.append(np.flatnonzero(np.append(True, (shared[1:] < size[1:]) | (size[1:] != size[:-1]))), n)
    group_end = same[np.searchsorted(same, first, side="right")]
    ending = np.where(size[first] == depth, group_end, first)
    head = first == 0
    shown = [str(i) for i in ids.tolist()]

    count = depth - above
    at = np.concatenate([[0], np.cumsum(count)])
    order = np.arange(len(first))
    for low in range(0, len(order), SLICE):
        # a long conversation's depths may be many: slices by rows
        some = order[low : low + SLICE]
        for of, x in _expanded(some, count, above):
            bottom, top = x == depth[of], x == above[of] + 1
            base = np.array([int(sums[j][d - 1]) if d else 0 for j, d in zip(first[of].tolist(), x.tolist())], "i8")
            own_piece = head[of] | tail[of]
            parent = np.where(top, up[of], of)
            up_open = (parent >= 0) & (head[parent] | tail[parent])
            hashes = [None] * len(of)
            for k in np.flatnonzero(~own_piece):
                r = of[k]
                hashes[k] = hashlib.sha256(",".join(shown[first[r] : ending[r]]).encode()).hexdigest() if bottom[k] and ending[r] > first[r] else NONE
            yield {
                "kind": np.where(own_piece, PIECE, WHOLE), "block": block, "conv_id": least[of], "depth": x, "parent_conv_id": [None if o or d == 0 else v for o, d, v in zip(up_open.tolist(), x.tolist(), least[parent].tolist())],
                "n_convs": last[of] - first[of] + 1, "n_children": np.where(bottom, kids[of], ~head[of]), "n_leaves": leaf[last[of] + 1] - leaf[first[of]], "saved_tokens": saved[last[of]] - saved[first[of]] - (last[of] - first[of]) * base,
                "head": head[of], "up_head": head[parent], "tail": tail[of], "below": base, "ends_sha256": hashes,
            }
            for k in np.flatnonzero(own_piece & bottom & (ending[of] > first[of])):
                r = of[k]
                yield from _ends(block, int(depth[r]), bool(head[r]), shown[first[r] : ending[r]])
    inner = int(shared[1:].min()) if n > 1 else np.iinfo("i8").max
    yield {"kind": BLOCK, "block": block, "n_convs": n, "depth": inner, "n_children": length[0], "n_leaves": length[-1], "data": [keys[0]], "last": [keys[-1]], "sums": [sums[0].astype("<i8").tobytes()]}


def _expanded(some: np.ndarray, count: np.ndarray, above: np.ndarray):
    """Runs, and each depth they stand for, some SLICE rows at a time."""
    at = 0
    while at < len(some):
        n = np.cumsum(count[some[at:]])
        take = max(1, int(np.searchsorted(n, SLICE, side="right")))
        of = some[at : at + take]
        total = int(n[take - 1])
        for low in range(0, total, SLICE):
            places = np.arange(low, min(total, low + SLICE))
            k = np.searchsorted(n, places, side="right")
            yield of[k], above[of[k]] + 1 + places - (n[k] - count[of[k]])
        at += take


def _ends(block: int, depth: int, head: bool, ids: list[str]):
    rest, seq, begin = ids, 0, 0
    step = max(1, CHUNK // 21)
    for begin in range(0, len(rest), step):
        yield {"kind": ENDS, "block": block, "depth": depth, "head": head, "seq": seq, "data": [",".join(rest[begin : begin + step]).encode()]}
        seq += 1


def _batch(made: dict) -> pa.RecordBatch:
    n = max((len(v) for v in made.values() if isinstance(v, (list, np.ndarray))), default=1)
    columns = []
    for c in NUMBERS:
        v = made.get(c)
        v = [v] * n if not isinstance(v, (list, np.ndarray)) else v
        columns.append(pa.array(v.astype("i8") if isinstance(v, np.ndarray) else [x if x is None else int(x) for x in v], pa.int64()))
    for c, kind in (("ends_sha256", pa.string()), ("data", pa.binary()), ("last", pa.binary()), ("sums", pa.binary())):
        columns.append(pa.array(made.get(c, [None] * n), kind))
    return pa.RecordBatch.from_arrays(columns, names=[*NUMBERS, "ends_sha256", "data", "last", "sums"])


def _blocks(convs: DataFrame, n: int) -> DataFrame:
    """What the blocks of the sorted conversations say (columns OUT); a block is a task's range."""

    def run(batches):
        from pyspark import TaskContext

        ids, keys, sizes = [], [], []
        for b in batches:
            ids.append(b.column(0).to_numpy())
            keys += b.column(1).to_pylist()
            flat, at = b.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy())])
            sizes += [flat[i:j] for i, j in zip(at, at[1:])]
        if keys:
            for made in block_rows(TaskContext.get().partitionId(), np.concatenate(ids), keys, sizes):
                yield _batch(made)
        at_rest()

    return convs.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(run, OUT)


def _gaps(blocks: DataFrame) -> DataFrame:
    """Rows (block, gap, sum, inner, first, last), one for each block: what its first conversation shares with the one before (-1: there is
    none), how many bytes that is, the least L behind its first, and the numbers of turns of its first and last conversation."""
    order = Window.orderBy("block")  # one row a block
    rows = blocks.filter(F.col("kind") == BLOCK).select("block", "depth", "n_children", "n_leaves", "data", "sums", F.lag("last").over(order).alias("before"))

    def run(batches):
        for b in batches:
            out = []
            for block, inner, first, last, key, sums, before in zip(*(c.to_pylist() for c in b.columns)):
                gap = -1 if before is None else shared_turns(before, key)
                out.append((block, gap, int(np.frombuffer(sums, "<i8")[max(0, gap)]), inner, first, last))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 6, names=["block", "gap", "sum", "inner", "first", "last"])

    return rows.mapInArrow(run, "block long, gap long, sum long, inner long, first long, last long")


class BlockMinima:
    """Nearest blocks with a value of L below a given one, from the blocks' minima."""

    def __init__(self, rows):
        rows = sorted(rows)
        self.blocks, self.gap, self.sum, self.inner, self.first, self.last = (np.array(x, "i8") for x in zip(*rows))
        self.next_gap = np.append(self.gap[1:], -1)
        self.tables = [np.minimum(self.gap, self.inner)]
        while 1 << len(self.tables) <= len(rows):
            half = 1 << len(self.tables) - 1
            t = self.tables[-1]
            # minimum of the 2 * half blocks that end at a place; before the first block all is as low as can be
            self.tables.append(np.minimum(t, np.concatenate([np.full(half, -1), t[:-half]])))

    def at(self, block: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.blocks, block)

    def start(self, at: np.ndarray, depth: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Where the node of each piece starts: 2 * its block, and one more unless at that block's first conversation."""
        moving = head & (self.gap[at] >= depth)
        to = at - 1  # the nearest block on the left with a value below the depth, its own gap included
        for k in range(len(self.tables) - 1, -1, -1):
            jump = moving & (to >= 0) & (self.tables[k][np.maximum(to, 0)] >= depth)
            to = np.where(jump, to - (1 << k), to)
        to = np.maximum(to, 0)
        return np.where(moving, 2 * self.blocks[to] + (self.inner[to] < depth), 2 * self.blocks[at] + ~head)


def _placed(rows: DataFrame, minima: BlockMinima) -> DataFrame:
    """Pieces (or ids that end at them) with the start of their node, and of its parent's; figures corrected by what lies before and behind the block."""
    names = ["start", "depth", "up_start", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "block", "seq"]

    def run(batches):
        for b in batches:
            get = lambda c: np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False)).astype("i8") if b.column(c).null_count else b.column(c).to_numpy()  # noqa: E731, B023
            at, depth, head, tail = minima.at(get("block")), get("depth"), get("head") == 1, get("tail") == 1
            gap = minima.gap[at]
            kids = get("n_children") + (head & (gap <= depth) & (depth < minima.first[at]))
            leaves = get("n_leaves") + (tail & (minima.next_gap[at] < minima.last[at]))
            saved = get("saved_tokens") + np.where(head & (gap >= depth), minima.sum[at] - get("below"), 0)
            made = [minima.start(at, depth, head), depth, np.where(depth > 0, minima.start(at, depth - 1, get("up_head") == 1), -1), None, get("n_convs"), kids, leaves, saved, get("block"), None]
            columns = [b.column("conv_id") if n == "conv_id" else b.column("seq") if n == "seq" else pa.array(x, pa.int64()) for n, x in zip(names, made)]
            yield pa.RecordBatch.from_arrays([*columns, b.column("data")], names=[*names, "data"])

    return rows.select(*NUMBERS, "data").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", data binary")


def _ends_hashes(rows: DataFrame) -> DataFrame:
    """Rows (start, depth, ends_sha256): one task streams a node's ids in the order of its blocks."""

    def run(batches):
        held, h, out = None, None, []
        for b in batches:
            for start, depth, data in zip(*(b.column(k).to_pylist() for k in (0, 1, 4))):
                if (start, depth) != held:
                    if held is not None:
                        out.append((*held, h.hexdigest()))
                    held, h = (start, depth), hashlib.sha256(data)
                else:
                    h.update(b"," + data)
            if len(out) > SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["start", "depth", "ends_sha256"])
                out = []
        if held is not None:
            out.append((*held, h.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["start", "depth", "ends_sha256"])

    dealt = rows.select("start", "depth", "block", "seq", "data").repartition("start", "depth").sortWithinPartitions("start", "depth", "block", "seq")
    return dealt.mapInArrow(run, "start long, depth long, ends_sha256 string")


def nodes(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie's nodes (columns NODE and ends_sha256) of conversations (conv_id, turns), turns being (hash, bytes)."""
    spark = convs.sparkSession
    scratch = Scratch(spark)
    convs = scratch.written(keyed(small_batches(convs)), "conversation-keys")
    turns = convs.agg(F.sum(F.size("sizes") + 1)).first()[0]
    wanted = max(shuffle_partitions(spark), -(-(turns or 0) // block_turns))
    found = scratch.written(_blocks(convs, wanted), "trie-blocks")
    facts = [tuple(r) for r in _gaps(found).collect()]  # six numbers a block
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not facts:
        return found.select(out)
    minima = BlockMinima(facts)
    pieces = _placed(found.filter(F.col("kind") == PIECE), minima)
    total = [F.sum(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    joined = pieces.groupBy("start", "depth").agg(F.min("conv_id").alias("conv_id"), F.min("up_start").alias("up_start"), *total)
    ends = _ends_hashes(_placed(found.filter(F.col("kind") == ENDS), minima))
    joined = scratch.written(joined.join(ends, ["start", "depth"], "left"), "trie-joints")
    parents = joined.select(F.col("start").alias("up_start"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up"), F.col("n_children").alias("kids"))
    inside = found.filter((F.col("kind") == WHOLE) & F.col("parent_conv_id").isNull())
    # a whole node whose parent is a piece: the parent's start is that of the piece in this block
    orphans = _orphans(inside, minima).unionByName(joined.select("up_start", *[c for c in out if c != "parent_conv_id"]))
    if joined.count() <= BROADCAST_ROWS:
        named = orphans.join(F.broadcast(parents), ["up_start", "depth"], "left")
    else:
        named = spread_join(orphans, parents, ["up_start", "depth"], "kids", F.xxhash64("conv_id", "depth"))
    named = named.withColumn("parent_conv_id", F.col("up")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
    whole = found.filter((F.col("kind") == WHOLE) & F.col("parent_conv_id").isNotNull())
    return whole.select(out).unionByName(named.select(out))


def _orphans(rows: DataFrame, minima: BlockMinima) -> DataFrame:
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]

    def run(batches):
        for b in batches:
            at = minima.at(b.column("block").to_numpy())
            up = minima.start(at, b.column("depth").to_numpy() - 1, b.column("up_head").to_numpy() == 1)
            yield pa.RecordBatch.from_arrays([pa.array(up, pa.int64()), *(b.column(c) for c in columns), b.column("ends_sha256")], names=["up_start", *columns, "ends_sha256"])

    return rows.select("block", "up_head", *columns, "ends_sha256").mapInArrow(run, "up_start long, " + ", ".join(f"{c} long" for c in columns) + ", ends_sha256 string")
