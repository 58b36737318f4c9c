"""Fill-in-middle transformation by bit-parallel big integers.

A text's UTF-8 bytes become one big integer of one byte a byte: ``bytes.translate`` marks a class of bytes
(line ends, white space, continuation bytes) with 1 and all others with 0, a shift and a boolean operation then mark where
units start, ``bit_count`` says how many units n there are, and the place of the k-th start is found by halving the
integer over and over, each time keeping the half that holds it.  So no unit is ever visited by itself, and time is linear in the text's length.

Units: ``line`` ends behind each line feed; ``word`` starts at a byte that isn't ASCII white space behind one that is (white space
at the text's start is a unit of its own); ``char`` is a code point.

A document's draws are the first four 8-digit groups h1 to h4 of the hex sha256 of ``<seed>:<decimal id>``.  The prefix ends behind
the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle behind the larger, the suffix is the rest.  Form ``plain``
(the text as it is) where the text is empty, holds a marker, or h3 % 100 isn't below ``rate``; else ``spm`` where h4 % 100 is below
``spm_rate``; else ``psm``.  ``restore`` rebuilds the text from output and form alone.  That is exact, as no marker is in the text and
none can arise where parts meet: a marker's first character stands nowhere else in the markers.

Cases: a null text counts as empty: n is 0, form plain, output empty; a null id draws as an empty string of digits; repeated rows give repeated
results; very long texts are read whole, some four integers of the text's size at a time; the caller's columns are kept, those named
like one that is made as ``<name>_input``; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_rest, set_aside, small_batches

#: Prefix, suffix and middle markers.
MARKERS = ("<P>", "<S>", "<M>")
#: Documents whose outputs a worker holds at a time.
SLICE = 256


def marks(*classes: range | bytes) -> bytes:
    """A table for ``bytes.translate``: 1 for the bytes of the classes, else 0."""
    inside = {b for c in classes for b in c}
    return bytes(b in inside for b in range(256))


LINE_END, SPACE, INNER = marks(b"\n"), marks(b" ", range(9, 14)), marks(range(0x80, 0xC0))


def as_bits(data: bytes, table: bytes) -> int:
    """Bit 8 * i says whether byte i is in the table's class."""
    return int.from_bytes(data.translate(table), "little")


def every(n: int) -> int:
    """Bit 8 * i set for each i below n."""
    return int.from_bytes(b"\1" * n, "little")


def starts(data: bytes, unit: str) -> int:
    """Bit 8 * i says whether a unit starts at byte i."""
    whole = every(len(data))
    if unit == "line":
        return (as_bits(data, LINE_END) << 8 | 1) & whole
    if unit == "word":
        space = as_bits(data, SPACE)
        return (space << 8 & ~space | 1) & whole
    if unit == "char":
        return whole ^ as_bits(data, INNER)
    raise ValueError(f"no such unit: {unit}")


def place(bits: int, k: int, size: int) -> int:
    """Byte of the k-th (from 0) start among ``size`` bytes, or ``size`` if there are no more than k."""
    if k >= bits.bit_count():
        return size
    at = 0
    while size > 1:
        half = size // 2
        low = bits & (1 << 8 * half) - 1
        n = low.bit_count()
        if k < n:
            bits, size = low, half
        else:
            bits, size, k, at = bits >> 8 * half, size - half, k - n, at + half
    return at


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def cut(data: bytes, unit: str, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of units, and the bytes where prefix and middle end."""
    bits = starts(data, unit)
    n = bits.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, place(bits, a, len(data)), place(bits, b, len(data))


def n_chars(data: bytes) -> int:
    return len(data) - as_bits(data, INNER).bit_count()


def checked(markers: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    joined = "".join(markers)
    if len(set(markers)) < 3 or any(not m or joined.count(m[0]) != sum(x[0] == m[0] for x in markers) for m in markers) or any(a != b and b.startswith(a) for a in markers for b in markers):
        raise ValueError("markers must differ, none may start another, and a marker's first character may stand only first in markers")
    return tuple(m.encode() for m in markers)


def transformed(data: bytes, doc_id: int | None, unit: str, rate: int, spm_rate: int, seed: int, markers: tuple[bytes, bytes, bytes]):
    """Number of units, form, code points of prefix and middle (None where plain), output."""
    p, s, m = markers
    h1, h2, h3, h4 = draws(seed, doc_id)
    n, a, b = cut(data, unit, h1, h2)
    if not data or h3 % 100 >= rate or any(x in data for x in markers):
        return n, "plain", None, None, data
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    form, out = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < spm_rate else ("psm", (p, prefix, s, suffix, m, middle))
    return n, form, n_chars(prefix), n_chars(middle), b"".join(out)


def restored(output: bytes, form: str, markers: tuple[bytes, bytes, bytes]) -> bytes:
    if form == "plain":
        return output
    p, s, m = markers
    first, second = (s, p) if form == "spm" else (p, s)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(m)
    return two + middle + one if form == "spm" else one + middle + two


def _sliced(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _raw(column) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary())]


def transform(docs: DataFrame, unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output.  One pass, no shuffle."""
    marked = checked(markers)
    starts(b"", unit)
    docs = set_aside(small_batches(docs), *(c for c in ("n", "form", "prefix_chars", "middle_chars", "output") if c not in (id_col, text_col)))
    at, of = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches):
        for b in _sliced(batches):
            made = [transformed(x, i, unit, rate, spm_rate, seed, marked) for x, i in zip(_raw(b.column(at)), b.column(of).to_pylist())]
            n, form, prefix, middle, out = zip(*made)
            new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string(), safe=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "n", "form", "prefix_chars", "middle_chars", "output"])
        at_rest()

    made = docs.select("*", F.lit(0).cast("long").alias("n"), F.lit("").alias("form"), F.lit(0).cast("long").alias("prefix_chars"), F.lit(0).cast("long").alias("middle_chars"), F.lit("").alias("output")).schema
    for f in made.fields:
        f.nullable = True
    return docs.mapInArrow(run, made)


def restore(df: DataFrame, markers: tuple[str, str, str] = MARKERS, output_col: str = "output", form_col: str = "form", out: str = "restored") -> DataFrame:
    """``df`` with the text rebuilt from output and form alone."""
    marked = checked(markers)

    @F.arrow_udf("string")
    def apply(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([restored(x, f, marked) for x, f in zip(_raw(outputs), forms.to_pylist())], pa.binary()).cast(pa.string(), safe=False)

    return set_aside(small_batches(df), out).withColumn(out, apply(F.col(output_col), F.col(form_col)))
