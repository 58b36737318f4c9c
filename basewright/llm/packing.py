"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of
n's binary form, with as many pieces of the longest length as it needs.  Pieces
of equal length share a bucket, so a training batch takes sequences of one
bucket; each piece is a sequence of its own.  No sequence crosses documents and,
as every length is a power of two, none is padded.

One pass over the documents, no shuffle: a sequence's id is its partition's
number and a counter there, as for monotonically_increasing_id.

Cases: a null or empty text still has its end id, one piece of length 1;
repeated rows and null ids give pieces with sequence ids of their own; a text of any length becomes
as many pieces as it needs; columns other than id and text aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from .bpe import LibraryBpe, coder, default_path
from .common import at_rest, small_batches

END_ID = 2
MAX_LENGTH = 4096
#: Documents whose pieces are sent on together, so that a task holds few ids at a time.
SLICE = 256


def lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Longest pieces first: n as a sum of powers of two, none above ``longest``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, longest: int = MAX_LENGTH, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: the document's id, start, length, bucket (log2 of the
    length), ids (array<int>, if keep_ids), ids_crc32, doc_tokens, sequence_id, offset."""
    if longest & longest - 1:
        raise ValueError("the longest length must be a power of two")
    path = path or default_path()
    import numpy as np
    import pyarrow as pa

    names = [id_col, "start", "length", "bucket", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        from pyspark import TaskContext

        c, made = coder(path, LibraryBpe), TaskContext.get().partitionId() << 33
        end = c.packed([end_id])
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            rows, of, kept = [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.frombuffer(c.encode_bytes(text.as_py()) + end, "<u4")
                start, n = 0, len(ids)
                for k in lengths(n, longest):
                    piece = ids[start : start + k]
                    rows.append((start, k, k.bit_length() - 1, zlib.crc32(piece), n, made, 0))
                    of.append(i)
                    if keep_ids:
                        kept.append(piece.astype("i4"))
                    start, made = start + k, made + 1
            columns = [b.column(0).take(pa.array(of, pa.int64()))] + [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names=names)
        at_rest()

    kind = dict(docs.dtypes)[id_col]
    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, bucket int, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces in one folder for each bucket, so that a training batch reads sequences of one length; each task writes to the
    folders on its own, so a bucket that holds most pieces needs no task of its own."""
    pieces.write.partitionBy("bucket").parquet(path, mode="overwrite")
