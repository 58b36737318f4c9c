"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text's sections are the blocks between blank lines, a section's paragraphs its lines, and a
paragraph's leaves runs up to a sentence end (of Latin, Chinese or Japanese writing), cut further after every word whose last code
point is one more than a multiple of four, and after ``LEAF_WORDS`` words at the latest.  A stretch of more than ``STRETCH`` code
points without white space is cut where a hash of its near code points says so, after ``STRETCH`` at the latest.  The text's
length plays no part, and leaves fall in with each other again soon after an edit, in short
texts too.  Every character belongs to one leaf.  A leaf's hash is that of its text, every other
node's that of its children's hashes and lengths alone.

The fingerprint is the string ``root|section:paragraph=leaf.length,leaf.length;paragraph=...|section:...``
(lengths in code points, hexadecimal).  Equal texts have equal fingerprints, and roots test equality.
``likeness`` and ``differing`` descend from the roots, level by level, only into nodes that the other
tree lacks.  ``likeness`` is the share of characters in nodes that both have: twice the common length
over the sum of the lengths.  ``differing`` gives the edits between the two texts.

Cases: a null text is an empty one: length 0 and no section; two empty texts have
likeness 1, an empty and another one 0.  Documents with equal ids follow each other
by text hash; null ids come last; a single document is followed by itself; texts of any length are
read whole, in time linear in it; columns other than id and text aren't read by ``compare_with_next``,
``fingerprints`` keeps them all, one named as its output as ``<name>_input``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from base64 import urlsafe_b64encode
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_in_order, set_aside, shuffle_partitions, small_batches, text_hash

#: Words in a leaf at most; bytes of a node's hash, a multiple of three, so that hashes in a row become text together; characters of that text.
LEAF_WORDS, HASH_BYTES = 6, 9
HASH_CHARS = HASH_BYTES // 3 * 4
#: Documents sent on together.
SLICE = 256
blank_line = re.compile(r"(\n[^\S\n]*\n\s*)")
ENDS = ".!?\u3002\uff01\uff0e\uff1f\uff61"
runs = re.compile(rf"[^{ENDS}\n]*[{ENDS}\n]+\s*|[^{ENDS}\n]+").findall
#: Longest leaf without white space, how many code points decide on a cut in a longer one, least length between cuts, one place in so many is a cut.
STRETCH, NEAR, LEAST, EVERY = 200, 6, 8, 24
long_stretch = re.compile(rf"(\S{{{STRETCH + 1},}})")
closing = "".join(re.escape(chr(c)) for c in range(1, 1 << 16, 4) if not chr(c).isspace())
pieces = re.compile(r"\s*(?:\S{1,200}+(?<![%s])\s+){0,%d}\S{1,200}\s*|\s+" % (closing, LEAF_WORDS - 1)).findall


class Node(NamedTuple):
    """hash.length as text, length in code points, children (none of a leaf)."""

    mark: str
    size: int
    children: tuple


def leaf_nodes(texts: list[str]) -> list[Node]:
    """Their leaves; the hashes become text in one step."""
    blake2b = hashlib.blake2b
    try:
        digests = [blake2b(x.encode(), digest_size=HASH_BYTES).digest() for x in texts]
    except UnicodeEncodeError:
        digests = [blake2b(x.encode("utf-8", "surrogatepass"), digest_size=HASH_BYTES).digest() for x in texts]
    names, sizes = urlsafe_b64encode(b"".join(digests)).decode(), list(map(len, texts))
    marks = [f"{names[at : at + HASH_CHARS]}.{size:x}" for at, size in zip(range(0, len(names), HASH_CHARS), sizes)]
    return list(map(Node, marks, sizes, repeat(())))


def over(children: list[Node]) -> Node:
    """The node whose children these are; its hash is of theirs."""
    h = hashlib.blake2b(",".join([x.mark for x in children]).encode(), digest_size=HASH_BYTES).digest()
    size = sum([x.size for x in children])
    return Node(f"{urlsafe_b64encode(h).decode()}.{size:x}", size, tuple(children))


def sections(text: str) -> list[str]:
    parts = blank_line.split(text)
    return [x for x in (a + b for a, b in zip(parts[::2], [*parts[1::2], ""])) if x]


def paragraphs(section: str) -> list[str]:
    lines = section.split("\n")
    return [x for x in [*(line + "\n" for line in lines[:-1]), lines[-1]] if x]


def cut_by_content(stretch: str) -> list[str]:
    """Pieces of a long stretch without white space; where it is cut depends on the code points before the cut, not on where the stretch starts."""
    codes = np.frombuffer(stretch.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    n = len(codes) - NEAR + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, "u8")
        for k in range(NEAR):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        cuts = (np.flatnonzero((h ^ h >> np.uint64(32)) % np.uint64(EVERY) == 0) + NEAR).tolist()
    out, at = [], 0
    for c in [*cuts, len(stretch)]:
        if c - at < LEAST and c < len(stretch):
            continue
        while c - at > STRETCH:
            out.append(stretch[at : at + STRETCH])
            at += STRETCH
        if c > at:
            out.append(stretch[at:c])
            at = c
    return out


def leaves(paragraph: str) -> list[str]:
    out = []
    for run in runs(paragraph):
        if len(run) > STRETCH and long_stretch.search(run):
            for k, part in enumerate(long_stretch.split(run)):
                out += cut_by_content(part) if k % 2 else pieces(part)
        else:
            out += pieces(run)
    return out


def tree(text: str | None, known: dict[str, Node] | None = None) -> Node:
    """``known``: nodes of paragraphs by their text, which are taken from there; new ones are added."""
    known = {} if known is None else known

    def paragraph(p: str) -> Node:
        node = known.get(p)
        if node is None:
            node = known[p] = over(leaf_nodes(leaves(p)))
        return node

    return over([over([paragraph(p) for p in paragraphs(s)]) for s in sections(text or "")])


def shown(root: Node) -> str:
    name = lambda node: node.mark.partition(".")[0]
    return "|".join([name(root), *(f"{name(s)}:" + ";".join([f"{name(p)}=" + ",".join([x.mark for x in p.children]) for p in s.children]) for s in root.children)])


def fingerprint(text: str | None) -> str:
    return shown(tree(text))


def parsed(mark: str) -> Node:
    """The tree of a fingerprint."""

    def made(name: str, children: list[Node]) -> Node:
        size = sum(x.size for x in children)
        return Node(f"{name}.{size:x}", size, tuple(children))

    def paragraph(text: str) -> Node:
        name, _, body = text.partition("=")
        return made(name, [Node(x, int(x.partition(".")[2], 16), ()) for x in body.split(",")])

    root, *rest = mark.split("|")
    found = []
    for text in rest:
        name, _, body = text.partition(":")
        found.append(made(name, [paragraph(x) for x in body.split(";")]))
    return made(root, found)


def common(a: list[Node], b: list[Node]) -> int:
    """Characters of a's nodes that b has too; below nodes that the other side lacks, of their children."""
    if not a or not b:
        return 0
    held, size = Counter([x.mark for x in b]), 0
    left_a = []
    for x in a:
        if held.get(x.mark, 0) > 0:
            held[x.mark] -= 1
            size += x.size
        else:
            left_a.append(x)
    if a[0].children:
        left_b = []
        for x in b:
            if held.get(x.mark, 0) > 0:
                held[x.mark] -= 1
                left_b.append(x)
        size += common([y for x in left_a for y in x.children], [y for x in left_b for y in x.children])
    return size


def likeness(a: str | Node, b: str | Node) -> float:
    """Of two fingerprints or trees."""
    a, b = (parsed(x) if isinstance(x, str) else x for x in (a, b))
    return 1.0 if a.mark == b.mark else 2 * common(list(a.children), list(b.children)) / (a.size + b.size)


def differing(a: str | Node, b: str | Node) -> list[tuple[int, int, int, int]]:
    """The edits between two texts, in order: characters [i, j) of a's text became [k, l) of b's; where one range is empty,
    text was inserted or deleted (text that moved is deleted at one place and inserted at another)."""
    a, b = (parsed(x) if isinstance(x, str) else x for x in (a, b))
    out: list[tuple[int, int, int, int]] = []

    def add(i, j, k, l):  # noqa: E741
        if out and out[-1][1] == i and out[-1][3] == k:
            i, k = out.pop()[::2]
        out.append((i, j, k, l))

    def walk(xs, ys, i, k):
        ends = lambda nodes, at: [at, *(at := at + x.size for x in nodes)]  # noqa: E731, F841
        left, right = ends(xs, i), ends(ys, k)
        for kind, p, q, u, v in SequenceMatcher(None, [x.mark for x in xs], [y.mark for y in ys], autojunk=False).get_opcodes():
            if kind == "equal":
                continue
            if xs[p:q] and ys[u:v] and xs[p].children:
                walk([c for x in xs[p:q] for c in x.children], [c for y in ys[u:v] for c in y.children], left[p], right[u])
            else:
                add(left[p], left[q], right[u], right[v])

    if a.mark != b.mark:
        walk(list(a.children), list(b.children), 0, 0)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each row's whole text."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py()) for x in texts], pa.string())

    return set_aside(small_batches(docs), *[out] * (out.lower() != text_col.lower())).withColumn(out, run(F.col(text_col)))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of another text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, extra, doc_id, text) in order; each but a run's last meets its follower.  An edited text takes the nodes of the paragraphs it
    shares with the two texts it is made of, so only those at its seam and its end are cut and hashed anew."""
    held = None
    for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
        out = []
        for run, extra, i, text in zip(*(b.column(k).to_pylist() for k in range(4))):
            known: dict[str, Node] = {}
            root = tree(text, known)
            if held is not None and held[0] == run:
                _, i0, t0, r0, known0 = held
                edited = edited_text(t0, text)
                e = tree(edited, known0 | known)
                out.append((i0, len(t0), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(r0), shown(e), likeness(r0, e), likeness(r0, root)))
            held = None if extra else (run, i, text, root, known)
        columns = list(zip(*out)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, KINDS)], names=[x.split()[0] for x in OUT.split(", ")])


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses.

    Documents are dealt out by ranges of the id, each range sorted, so a text
    meets its follower in one pass; a range also gets a copy of the next range's
    first document (one text a range).  One shuffle of the texts.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", text_hash("text"))
    run, n = dealt_in_order(rows, "doc_id", "tie", shuffle_partitions(docs.sparkSession), descending=True)
    rows = rows.withColumn("run", run)
    # ids descend with nulls last; the bitwise complement descends as the id ascends, and nulls are in runs of their own
    first = rows.groupBy("run").agg(F.min(F.struct(F.expr("~doc_id").alias("id"), "tie")).alias("first")).orderBy("run").collect()  # one row a run
    if not first:
        return rows.mapInArrow(lambda batches: iter(()), OUT)
    back = {r["run"]: first[i - 1]["run"] for i, r in enumerate(first)}
    known = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("run"))
    ids = known({r["run"]: None if r["first"]["id"] is None else ~r["first"]["id"] for r in first}).cast("long")
    heads = rows.filter(F.col("doc_id").eqNullSafe(ids) & (F.col("tie") == known({r["run"]: r["first"]["tie"] for r in first})))
    heads = heads.groupBy("run").agg(F.first("text").alias("text"), F.first("doc_id").alias("doc_id"), F.first("tie").alias("tie"))
    heads = heads.select("doc_id", "text", "tie", known(back).cast("int").alias("run"), F.lit(1).alias("extra"))
    dealt = rows.withColumn("extra", F.lit(0)).unionByName(heads).repartitionById(n, "run")
    dealt = dealt.sortWithinPartitions("run", "extra", F.col("doc_id").desc_nulls_last(), "tie").select("run", "extra", "doc_id", "text")
    return dealt.mapInArrow(walk, OUT)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
