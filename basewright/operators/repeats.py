"""Repeat content of a sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "struct<repeat:string,sequence:string,prop:double>"
#: Sequences up to this length are sorted by their suffixes as they are; arrays would take longer to set up.
SHORT = 200


def suffix_array(seq: str) -> np.ndarray:
    """Starts of all suffixes in their order, by prefix doubling.

    Ranks of the first ``width`` characters of every suffix become those of twice as many by sorting pairs of them. As many characters as
    fit into a whole number are packed at the start, so few rounds follow unless long stretches repeat; time is n log n a round, rounds at most log n.
    """
    codes = np.unique(np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)[1]
    n, key = len(codes), codes.astype("i8") + 1  # 0 stands behind the end
    bits, width = int(key.max(initial=1)).bit_length(), 1
    behind = lambda x: np.concatenate([x[width:], np.zeros(min(width, n), x.dtype)])
    while 2 * width * bits <= 62:
        key, width = key << width * bits | behind(key), 2 * width
    while True:
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        new = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])]) if n else order
        if not n or new[-1] == n - 1:
            return order
        rank = np.empty(n, "i8")
        rank[order] = new + 1
        key, width = rank * (n + 1) + behind(rank), 2 * width


def shared_prefixes(seq: str, order: np.ndarray) -> np.ndarray:
    """What each suffix of the order shares with the one before it (Kasai's method: going on by one character loses at most one)."""
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    out, h = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        most = n - max(i, j)
        while h < most and seq[i + h] == seq[j + h]:
            h += 1
        out[i] = h
        h -= h > 0
    return np.array(out, "i8")[order]


def longest_repeat(seq: str) -> tuple[str, list[int]]:
    """The longest substring that occurs at least twice (overlaps count), the greatest of equally long ones, and where it occurs."""
    if len(seq) <= SHORT:
        suffixes, most, unit = sorted(seq[i:] for i in range(len(seq))), 0, ""
        for a, b in zip(suffixes, suffixes[1:]):
            n = most  # one that is shorter than the longest so far isn't measured
            if n and a[:n] != b[:n]:
                continue
            while n < len(a) and a[n] == b[n]:
                n += 1
            if n:
                most, unit = n, a[:n]
        return unit, [i for i in range(len(seq) - most + 1) if unit and seq.startswith(unit, i)]
    order = suffix_array(seq)
    shared = shared_prefixes(seq, order)
    most = int(shared.max(initial=0))
    if not most:
        return "", []
    last = len(shared) - 1 - int(np.argmax(shared[::-1] == most))  # of equally long ones the greatest comes last
    first = last
    while first > 0 and shared[first] == most:
        first -= 1
    at = np.sort(order[first : last + 1]).tolist()
    return seq[at[0] : at[0] + most], at


def largest_repeat(seq: str | None) -> tuple[str, str, float] | None:
    """Kind (scaffold, homopolymer or repeat), unit and the share of the sequence that the unit's occurrences cover.

    Occurrences further apart than the unit's length add nothing; a unit that covers just itself is no repeat.
    """
    unit, at = longest_repeat(seq or "")
    if not unit:
        return None
    n = len(unit)
    total = n + sum(d for a, b in zip(at, at[1:]) if (d := b - a) <= n)
    if total == n:
        return None
    kind = "scaffold" if "N" in unit else "homopolymer" if len(set(unit)) == 1 else "repeat"
    return kind, unit, total / len(seq)


def with_largest_repeat(frame: DataFrame, col: str, out: str = "largest") -> DataFrame:
    """``frame`` with a struct (repeat, sequence, prop) for a column of sequences; its fields are null without a repeat."""

    def largest(seqs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([largest_repeat(s) or (None, None, None) for s in seqs], columns=["repeat", "sequence", "prop"])

    return frame.withColumn(out, F.pandas_udf(largest, KIND)(F.col(col)))


def parse_repeat(text: Column) -> Column:
    """A repeat kind's canonical name, whatever its case; null for anything else."""
    name = F.lower(text)
    return F.when(name.isin("scaffold", "homopolymer", "repeat"), name)
