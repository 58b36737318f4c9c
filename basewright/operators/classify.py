"""From signals to a status for every base, and from those to intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .intervals import position_runs
from .peaks import find_peaks

PART = ["region_id", "bin"]


def signals(frame: DataFrame, cfg: Config, part: list[str] | None = None) -> DataFrame:
    """Peaks of all five signals on one frame.

    Where a sparse signal (mismatch, indel, softclip) is zero its value is null, as it would be
    after joining frames of peaks without zeroes; the joins themselves aren't needed.
    """
    c, m, i, s, q = cfg.cov, cfg.mismatch, cfg.indel, cfg.softclip, cfg.mapq
    both = lambda z, drop: (z, z, drop)
    return find_peaks(frame, {"cov": (c.n_zscores_low, c.n_zscores_high, False), "mismatch": both(m.n_zscores_high, True), "indel": both(i.n_zscores_high, True), "softclip": both(s.n_zscores_high, True), "mapq": both(q.n_zscores_low, False)}, part or PART, "cov", cfg.compat_single)


def classify_bases(frame: DataFrame, cfg: Config) -> DataFrame:
    """Adds ``status`` to a frame of ``signals``.  Comparisons of ratios are free of divisions, so no coverage is a special case;
    in 32-bit floats they are quotients, and any value is a high share of no coverage."""
    base = F.lit(cfg.cov.baseline) if cfg.cov.baseline is not None else F.floor("__whole")
    frame = frame.withColumn("__base", base)
    cov, low_mapq = F.col("cov"), F.col("mapq_peak") == "low"
    kind = "float" if cfg.compat_single else "double"
    number = lambda x: F.lit(float(x)).cast(kind)
    most = lambda ratio: F.floor(F.col("__base").cast(kind) * number(ratio))
    high = lambda x: F.col(f"{x}_peak") == "high"
    part_of = lambda x: F.when(cov != 0, (x.cast(kind) / cov.cast(kind)).cast(kind))
    enough = lambda x, ratio: F.when(cov == 0, x.isNotNull()).otherwise(part_of(x) >= number(ratio)) if cfg.compat_single else x >= cov * number(ratio)
    share = lambda x, ratio: F.coalesce(enough(F.col(x), ratio), F.lit(False)) & high(x)
    collapse = high("cov") & (cov >= most(cfg.cov.ratio_collapse)) & low_mapq & (high("mismatch") | high("indel"))
    misjoin = (cov == 0) | (F.col("cov_peak") == "low") & low_mapq & (cov <= most(cfg.cov.ratio_misjoin))
    false_dupe = (cov <= most(cfg.cov.ratio_false_dupe)) & (F.col("mapq_max") == 0)
    status = (
        F.when(share("mismatch", cfg.mismatch.ratio_het), "low_quality").when(collapse, "collapse").when(misjoin, "misjoin").when(false_dupe, "false_dupe")
        .when(share("indel", cfg.indel.ratio_indel), "indel").when(share("softclip", cfg.softclip.ratio_softclip), "softclip").otherwise("good")
    )
    return frame.withColumn("status", status).drop("__base", "__whole")


def status_intervals(frame: DataFrame, part: list[str] | None = None) -> DataFrame:
    """Rows (part, st, end, cov, status): runs of equal status and contiguity.

    A row is contiguous if its position is at most one more than the one before (0 before the
    first); a run ends where contiguity or status changes, so a segment's first base stands alone.
    The end is the last position plus one, coverage the mean, cut off.
    """
    runs = position_runs(frame, part or PART, "status", True, {"__sum": (F.sum("cov"), F.sum), "__n": (F.count("*"), F.sum)})
    return runs.select(*(part or PART), "st", (F.col("end") + 1).alias("end"), F.floor(F.col("__sum") / F.col("__n")).cast("long").alias("cov"), "status")


def above_runs(frame: DataFrame, level: str, part: list[str] | None = None) -> DataFrame:
    """Rows (part, above_st, above_end): runs with cov >= the level column that hold the part's first or last position."""
    part = part or PART
    edges = Window.partitionBy(*part)
    runs = position_runs(frame.withColumn("__above", F.col("cov") >= F.col(level)), part, "__above", False, {})
    runs = runs.withColumns({"__low": F.min("st").over(edges), "__high": F.max("end").over(edges)}).filter("__above and (st = __low or end = __high)")
    return runs.select(*part, F.col("st").alias("above_st"), F.col("end").alias("above_end"))


#: Good rows whose statistics one task makes at a time.
CHUNK = 1 << 16


def rolling_stats(frame: DataFrame, window: int, part: list[str] | None = None) -> DataFrame:
    """Rows (part, pos, roll_median, roll_stdev): centred over the good rows of a part.

    A running median has no built-in of less than window cost a row.  Good rows are numbered (by tiles of the
    axis, whose counts are summed up over a part) and cut into chunks with copies of half a window on
    either side; each chunk is one Arrow group of bounded length.
    """
    part = part or PART
    kinds = dict(frame.dtypes)
    good = frame.filter("status = 'good'").select(*part, "pos", F.col("cov").cast("double").alias("cov"), F.floor(F.col("pos") / CHUNK).alias("__tile"))
    counts = good.groupBy(*part, "__tile").agg(F.count("*").alias("n"))
    before = counts.select(*part, "__tile", F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = good.join(before, [*part, "__tile"]).withColumn("__nth", F.col("__before") + F.row_number().over(Window.partitionBy(*part, "__tile").orderBy("pos")))
    reach = window // 2 + 1
    place = lambda d: F.floor((F.col("__nth") + d) / CHUNK)
    copies = numbered.withColumn("__own", place(0)).withColumn("__chunk", F.explode(F.sequence(place(-reach), place(reach))))

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__nth")
        r = rows["cov"].rolling(window, center=True, min_periods=1)
        return rows.assign(roll_median=r.median(), roll_stdev=r.std())[rows["__own"] == rows["__chunk"]][[*part, "pos", "roll_median", "roll_stdev"]]

    return copies.select(*part, "pos", "cov", "__nth", "__own", "__chunk").groupBy(*part, "__chunk").applyInPandas(roll, ", ".join(f"`{c}` {kinds[c]}" for c in [*part, "pos"]) + ", roll_median double, roll_stdev double")


def bin_stats(frame: DataFrame, window: int, part: list[str] | None = None) -> DataFrame:
    """Rows (part, median, stdev) of each part's rolling medians and deviations; parts without a good row are absent."""
    part = part or PART
    return rolling_stats(frame, window, part).groupBy(*part).agg(F.median("roll_median").alias("median"), F.coalesce(F.median("roll_stdev"), F.lit(0.0)).alias("stdev"))
