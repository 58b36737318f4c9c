"""Substring dedup by sliding sentence spans.

Texts are cut into sentences (after words that end in ``.``, ``!``, ``?`` or their wide forms, and at line
ends), and these after every word whose hash is the least of the ``REACH`` words before and
behind it in the sentence.  Whether a word ends a piece so depends on its near words alone,
wherever the sentence starts: equal passages are cut alike at any offset, but for ``REACH``
words at their ends.  Pieces have more than ``REACH`` words, unless words repeat.  In what
follows a sentence is such a piece.  From every sentence starts a span: the shortest run of
at least ``SENTENCES`` sentences and ``WORDS`` words.  Spans are compared by 128-bit hashes of
their lower-cased words.  In writings that don't part words by spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese) each letter is
taken for a word, and two of them count as one of the ``WORDS``.  Of equal spans in all documents the first, in the order of id, text
hash and position, stays; sentences covered by any other are removed.

All spans are shuffled once, as five numbers each, by their hash.  Spans of very many
documents are found on a small sample first and dealt out over several tasks, each of which
finds the first of its part; the firsts of the parts are compared after.  The sample decides on
the dealing alone: the rows of a span that it misses go to one task, with the same result.

Cases: a null text stays null; texts shorter than a span stay as they are; a text
that is removed whole becomes empty; rows that are equal in id and text are
treated alike, null ids count as the smallest id; time is linear in a text's length; every
other column is kept, one named ``removed`` as ``removed_input``; an empty table stays empty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, at_rest, free_name, set_aside, small_batches, small_or_shuffled, text_hash

SENTENCES = 3
WORDS = 20
REACH = 3
#: A span's number of sentences in the low bits of its place, its first sentence above; no span has more than max(SENTENCES, 2 * WORDS).
PLACE_BITS = 6
#: Documents whose spans a worker holds at a time, words whose hashes it keeps.
SLICE, CACHE = 500, 100_000
#: Spans of more than this share of the documents (and HOT_ROWS) are dealt out over several tasks.
HOT_SHARE, HOT_ROWS, HOT_SEEN = 1 / 1000, 1000, 16
words_of = re.compile(r"\S+\s*").finditer
ENDS = ".!?\u3002\uff01\uff0e\uff1f\uff61"
#: Letters of writings without spaces between words: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]"
unspaced = re.compile(UNSPACED).search
mixed_words = re.compile(rf"{UNSPACED}|(?:(?!{UNSPACED})\S)+")
mixed_words_of = re.compile(rf"(?:{mixed_words.pattern})\s*").finditer
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """Lower-case word -> 64-bit hash; the lowest bit says whether it ends a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1 | (word[-1] in ENDS)
        self[word] = h
        return h


hash_of = WordHashes()
powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2 ** 64."""
    if k not in powers or len(powers[k][0]) < n:
        size, base = max(n, 1 << 14), int(BASES[k])
        with np.errstate(over="ignore"):
            powers[k] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, "u8"), np.full(size, b, "u8")])) for b in (base, pow(base, -1, 1 << 64)))
    return powers[k]


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def pieces(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, the number of words before each sentence and in all, and twice that number with letters of unspaced writings as halves."""
    words, lines = [], []
    split = mixed_words.findall if unspaced(text) else str.split
    for line in text.lower().split("\n"):
        words += split(line)
        lines.append(len(words))
    n = len(words)
    if not n:
        return np.empty(0, "u8"), np.zeros(1, "i8"), np.zeros(1, "i8")
    h = np.fromiter(map(hash_of.__getitem__, words), "u8", n)
    last = (h & np.uint64(1)).astype(bool)
    at = np.array(lines)
    last[at[at > 0] - 1] = True
    if n > 2 * REACH:
        inner = h[REACH : n - REACH]
        low = inner.copy()
        for d in range(1, REACH + 1):
            np.minimum(low, h[REACH - d : n - REACH - d], out=low)
            np.minimum(low, h[REACH + d : n - REACH + d], out=low)
        sentence = np.cumsum(last) - last
        last[REACH : n - REACH] |= (low == inner) & (sentence[: n - 2 * REACH] == sentence[2 * REACH :])
    last[-1] = True
    bounds = np.concatenate([[0], np.flatnonzero(last) + 1])
    if split is str.split:
        return h, bounds, 2 * bounds
    halves = np.fromiter((1 if unspaced(w) else 2 for w in words), "i8", n)
    return h, bounds, np.concatenate([[0], np.cumsum(halves)])[bounds]


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and two hashes of the span from each sentence that has one."""
    h, bounds, halves = pieces(text)
    count = len(bounds) - 1
    first = np.arange(count)
    end = np.maximum(first + SENTENCES, np.searchsorted(halves, halves[:-1] + 2 * WORDS))
    first, end = first[end <= count], end[end <= count]
    a, b, made = bounds[first], bounds[end], []
    if len(first):
        with np.errstate(over="ignore"):
            for k in (0, 1):
                up, down = power(k, len(h) + 1)
                total = np.concatenate([np.zeros(1, "u8"), np.cumsum(mix(h, 40 + k) * up[: len(h)], dtype="u8")])
                made.append(mix((total[b] - total[a]) * down[a], 50 + k).astype("i8"))
    else:
        made = [np.empty(0, "i8")] * 2
    return first << PLACE_BITS | end - first, *made


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence with the white space behind it; together they are the text."""
    _, bounds, _ = pieces(text)
    if len(bounds) < 2:
        return [(0, len(text))] if text else []
    ends = [m.end() for m in (mixed_words_of if unspaced(text) else words_of)(text)]
    at = [0, *(ends[i - 1] for i in bounds[1:].tolist())]
    return list(zip(at, at[1:]))


def without(text: str, covered: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the sentences of the spans at these places, and the character ranges that went."""
    parts = sentences(text)
    gone = [False] * len(parts)
    for place in covered:
        first, n = place >> PLACE_BITS, place & (1 << PLACE_BITS) - 1
        gone[first : first + n] = [True] * n
    ranges: list[tuple[int, int]] = []
    for (a, b), g in zip(parts, gone):
        if g:
            if ranges and ranges[-1][1] == a:
                ranges[-1] = (ranges[-1][0], b)
            else:
                ranges.append((a, b))
    return "".join(text[a:b] for (a, b), g in zip(parts, gone) if not g), ranges


def span_table(rows: DataFrame) -> DataFrame:
    """Rows (id, th, place, h1, h2), one for each span of each row (id, th, text)."""

    def run(batches):
        for b in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            found = [spans(x or "") for x in b.column(2).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            columns = [pa.array(np.concatenate([x[k] for x in found]) if found else [], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *columns], names=["id", "th", "place", "h1", "h2"])
        at_rest(hash_of, powers)

    return rows.select("id", "th", "text").mapInArrow(run, "id long, th long, place long, h1 long, h2 long")


def hot_spans(rows: DataFrame) -> DataFrame | None:
    """Rows (h1, parts): spans that a sample of the documents shows to be in very many, and the number of tasks for each."""
    n = rows.count()
    limit = max(HOT_ROWS, int(n * HOT_SHARE))
    if n <= limit:
        return None
    every = max(1, limit // HOT_SEEN)
    some = rows.filter(F.pmod(F.xxhash64("id", "th"), F.lit(every)) == 0)
    return span_table(some).groupBy("h1").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_SEEN).select("h1", F.ceil(F.col("n") * every / (limit / 8)).cast("int").alias("parts"))


def repeated(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, th, covered) of the rows (id, th, text): by document, the places of spans that stand elsewhere before."""
    table, hot = span_table(rows), hot_spans(rows)
    if hot is None:
        table = table.withColumns({"part": F.lit(0), "hot": F.lit(False)})
    else:
        several = F.coalesce(F.col("parts") > 1, F.lit(False))
        table = table.join(small_or_shuffled(scratch.written(hot, "hot-spans")), "h1", "left")
        table = table.select("id", "th", "place", "h1", "h2", F.when(several, F.pmod(F.xxhash64("id", "th"), F.col("parts")).cast("int")).otherwise(F.lit(0)).alias("part"), several.alias("hot"))
    place = F.struct("id", "th", "place")
    by = Window.partitionBy("h1", "h2", "part")
    met = table.withColumns({"n": F.count("*").over(by), "at": F.min(place).over(by)}).filter("n > 1 or hot")
    if hot is not None:
        met = scratch.written(met.select("id", "th", "place", "h1", "h2", "hot", "at"), "shared-spans")
        least = met.filter("hot").groupBy("h1", "h2").agg(F.min("at").alias("least"))
        met = met.join(small_or_shuffled(least), ["h1", "h2"], "left").withColumn("at", F.coalesce("least", "at"))
    gone = met.filter(~place.eqNullSafe(F.col("at"))).groupBy("id", "th").agg(F.collect_set("place").alias("covered"))
    gone = scratch.written(gone, "covered-spans")
    scratch.drop(but=(gone,))
    return gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated sentences taken out of the text, and a column ``removed`` of the
    character ranges (array<struct<start, end>>, null where nothing went)."""
    docs = set_aside(small_batches(docs), *["removed"] * (text_col.lower() != "removed"))
    own_id, th, covered, cut_col = (free_name(docs, x) for x in ("__id", "__th", "__covered", "__cut"))
    gone = repeated(docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("th"), F.col(text_col).alias("text")), Scratch(docs.sparkSession))
    mine = docs.withColumn(own_id, F.col(id_col).cast("long")).withColumn(th, text_hash(text_col))
    gone = gone.toDF("__gid_of_span", "__gth_of_span", covered)
    met = mine.join(gone, F.col(own_id).eqNullSafe(F.col("__gid_of_span")) & (F.col(th) == F.col("__gth_of_span")), "left")

    @F.arrow_udf("struct<text:string,removed:array<struct<start:int,end:int>>>")
    def cut(texts: pa.Array, covered: pa.Array) -> pa.Array:
        left, went = [], []
        for text, c in zip(texts.to_pylist(), covered.to_pylist()):
            x, ranges = (None, None) if c is None or text is None else without(text, c)
            left.append(x)
            went.append(ranges and [{"start": a, "end": b} for a, b in ranges])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(went, kind)], names=["text", "removed"])

    changed = F.col(covered).isNotNull()  # only their texts go to Python
    # so declared, it runs once even where both a filter and a result need it
    done = met.withColumn(cut_col, cut.asNondeterministic()(F.when(changed, F.col(text_col)), F.col(covered)))
    text = F.when(changed, F.col(f"{cut_col}.text")).otherwise(F.col(text_col))
    keep = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*keep, F.col(f"{cut_col}.removed").alias("removed"))
