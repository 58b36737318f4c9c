"""Peaks and dips by robust z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What makes a median and a mean absolute deviation comparable with a standard deviation.
MAD_SCALE, MEAN_SCALE = 1.486, 1.253314


def spread(frame: DataFrame, used: dict[str, F.Column], part: list[str], kind: str = "double") -> DataFrame:
    """Rows (part, X_m, X_mad, X_aad, X_whole), one for each part: median, median and mean absolute deviation of each signal X, and the
    median of its values cut to whole numbers.

    The frame is counted by part, signal and value once, with map-side combining; all statistics follow from these counts.
    """
    values = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), c.alias("v")) for x, c in used.items()]))
    counts = frame.select(*part, values.alias("e")).select(*part, "e.x", "e.v").filter("v is not null").groupBy(*part, "x", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*part, "x")
    median = lambda c: F.percentile(c, F.lit(0.5), F.col("n"))
    # sums are doubles in either mode; what is kept of them is of the mode's kind
    mean = lambda c: F.sum(c.cast("double") * F.col("n")) / F.sum("n")
    about = counts.withColumns({"m": median(F.col("v")).over(w).cast(kind), "mean": (F.sum(F.col("v").cast("double") * F.col("n")).over(w) / F.sum("n").over(w)).cast(kind)})
    stats = about.groupBy(*part, "x").agg(F.first("m").alias("m"), median(F.col("v").cast("long").cast("double")).alias("whole"), median(F.abs(F.col("v") - F.col("m"))).cast(kind).alias("mad"), mean(F.abs(F.col("v") - F.col("mean"))).cast(kind).alias("aad"))
    return stats.groupBy(*part).agg(*[F.max(F.when(F.col("x") == x, F.col(s))).alias(f"__{x}_{s}") for x in used for s in ("m", "mad", "aad", "whole")])


def find_peaks(frame: DataFrame, signals: dict[str, tuple[float, float, bool]], part: list[str], whole: str | None = None, single: bool = False) -> DataFrame:
    """Adds X_median, X_stdev, X_zscore and X_peak for each signal X: (low, high, drop zeroes).

    A dropped zero takes no part in the statistics;
    its peak is ``null`` (a string, as for all that is neither high nor low) and X itself becomes null.
    With no spread at all the z-score is NaN and the label high.  X ends as a whole number, cut off.
    ``whole``: a signal the median of whose whole numbers is added as ``__whole``.
    ``single``: values, statistics and z-scores are 32-bit floats, each step rounded, and it is the rounded z-score that meets the threshold.
    The statistics are one row a part, joined to the frame; where they are few, Spark broadcasts them.
    """
    kind = "float" if single else "double"
    number = lambda x: F.lit(x).cast(kind)
    used = {x: (F.when(F.col(x) != 0, F.col(x)) if drop else F.col(x)).cast(kind) for x, (_, _, drop) in signals.items()}
    stats = spread(frame, used, part, kind)
    keys = {f"__p{i}": c for i, c in enumerate(part)}
    on = [F.col(c).eqNullSafe(F.col(k)) for k, c in keys.items()]
    out = frame.join(stats.withColumnsRenamed({c: k for k, c in keys.items()}), on, "left").drop(*keys)
    made = {}
    for x, (low, high, _) in signals.items():
        v, mid = used[x], F.col(f"__{x}_m")
        scale = F.when(F.col(f"__{x}_mad") == 0, F.col(f"__{x}_aad") * number(MEAN_SCALE)).otherwise(F.col(f"__{x}_mad") * number(MAD_SCALE))
        made[f"{x}_stdev"] = F.when(v.isNotNull(), scale)
        # of two floats Spark divides as doubles; rounded once more that is the quotient of floats
        score = ((v - mid) / F.when(scale != 0, scale)).cast(kind)
        above, below = (score > number(high), score < number(-low)) if single else (v - mid > scale * high, v - mid < scale * -low)
        made[f"{x}_zscore"] = F.when(v.isNotNull(), F.when(scale == 0, number(float("nan"))).otherwise(score))
        made[f"{x}_peak"] = F.when(v.isNull(), "null").when(scale == 0, "high").when(above, "high").when(below, "low").otherwise("null")
        made[f"{x}_median"] = F.when(v.isNotNull(), mid)
        made[x] = v.cast("long")
    if whole:
        made["__whole"] = F.col(f"__{whole}_whole")
    return out.withColumns(made).drop(*[f"__{x}_{s}" for x in signals for s in ("m", "mad", "aad", "whole")])
