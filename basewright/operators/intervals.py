"""Interval algebra on DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of the pieces of the axis that ranges are spread over.
BUCKET = 1 << 17
#: Positions that are windows of their own where runs are looked for.
TILE = 1 << 16


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """Pairs of closed ranges that overlap and agree in ``keys``.

    Ranges are spread over buckets of the axis, which makes the join an equi-join
    (hash or sort-merge, split when skewed) instead of a nested loop; a pair is taken in
    the first bucket that both have, so it comes once.  ``how`` may be inner, or left_semi.
    Column names must differ but for the keys.
    """
    (a, b), (c, d) = left_range, right_range
    cells = lambda st, end: F.explode(F.sequence(F.floor(F.col(st) / bucket), F.floor(F.greatest(st, end) / bucket)))
    first = F.floor(F.greatest(a, c) / bucket) == F.col("__bucket")
    overlap = (F.col(a) <= F.col(d)) & (F.col(b) >= F.col(c))
    if how == "left_semi":
        # whether a range is hit depends on the range alone
        hit = range_least(left, right.withColumn("__hit", F.lit(1)), keys, left_range, right_range, "__hit").select(*keys, a, b)
        return left.join(hit, [*keys, a, b], "left_semi")
    x, y = left.withColumn("__bucket", cells(a, b)), right.withColumn("__bucket", cells(c, d))
    return x.join(y, [*keys, "__bucket"]).filter(first & overlap).drop("__bucket")


def _block(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at.cast("long"), level)


def _level(st: str, end: str) -> Column:
    """The highest level whose blocks may fit into the closed range."""
    return F.length(F.bin(F.col(end).cast("long") - F.col(st).cast("long") + 1)) - 1


def _inside(kind: str, st: Column, end: Column, top: Column) -> Column:
    """The blocks (kind, level, block) that a closed range is made of, two of a level at most.  A block of a level is 2 ** level positions, from a multiple of that on."""

    def at(level):
        first, after = -_block(-st, level), _block(end + 1, level)
        some = lambda n, odd: F.when((first < after) & (odd % 2 != 0), F.struct(F.lit(kind).alias("__kind"), level.alias("__level"), n.alias("__block")))
        return F.array(some(first, first), some(after - 1, after))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), at)))


def _around(kind: str, at: Column, top: Column) -> Column:
    """The blocks (kind, level, block) that hold a position, one of each level up to ``top``."""
    return F.transform(F.sequence(F.lit(0), top), lambda level: F.struct(F.lit(kind).alias("__kind"), level.alias("__level"), _block(at, level).alias("__block")))


def range_least(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], value: str) -> DataFrame:
    """Rows (keys, left_range, value), one for each different range of ``left`` that overlaps one of ``right``: the least value of those that it overlaps.

    Ranges are closed and agree in ``keys``; column names must differ but for these.  No pairs are made: a range of ``right`` holds the start of the
    one of ``left``, or starts in the rest of it.  In either case a position lies in a range, so one of the blocks around the position is among
    those that the range is made of.  A block of ``right`` keeps its least value only; a range has some blocks for each doubling of its length.
    Ranges that end before they start, which files don't have, overlap what holds both their ends; they go through pairs.
    """
    (a, b), (c, d) = left_range, right_range
    mine, other = left.select(*keys, a, b).distinct(), right.groupBy(*keys, c, d).agg(F.min(value).alias(value))
    own, theirs = mine.filter(F.col(a) <= F.col(b)), other.filter(F.col(c) <= F.col(d))
    top = lambda rows, st, end, name: rows.filter(F.col(st) <= F.col(end)).agg(F.coalesce(F.max(_level(st, end)), F.lit(0)).alias(name))
    tops = F.broadcast(top(left, a, b, "__own").join(F.broadcast(top(right, c, d, "__theirs"))))  # one row
    x = own.join(tops).select(*keys, a, b, F.inline(F.concat(_around("start", F.col(a), F.col("__theirs")), _inside("rest", F.col(a) + 1, F.col(b), F.col("__own")))))
    y = theirs.join(tops).select(*keys, value, F.inline(F.concat(_inside("start", F.col(c), F.col(d), F.col("__theirs")), _around("rest", F.col(c), F.col("__own")))))
    block = [*keys, "__kind", "__level", "__block"]
    met = x.join(y.groupBy(*block).agg(F.min(value).alias(value)), block)
    odd = [range_join(mine.filter(F.col(b) < F.col(a)), other, keys, left_range, right_range), range_join(own, other.filter(F.col(d) < F.col(c)), keys, left_range, right_range)]
    for pairs in odd:
        met = met.select(*keys, a, b, value).unionByName(pairs.select(*keys, a, b, value))
    return met.groupBy(*keys, a, b).agg(F.min(value).alias(value))


def overlap_length(a_st: Column, a_end: Column, b_st: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_st, b_st)


def island(part: list[str], order: list, starts: Column) -> Column:
    """Running number of the islands that begin where ``starts`` holds."""
    return F.sum(starts.cast("int")).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def position_runs(frame: DataFrame, part: list[str], key: str, contiguous: bool, aggs: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """Rows (part, st, end, key, aggs): maximal runs of rows of equal ``key`` in the order of ``pos``; end is the last position.

    ``contiguous``: a row is near if its position is at most one more than the one before (0 before the first),
    and a run also ends where nearness changes.  ``aggs``: for each further column how it is made from rows, and
    how from parts of a run.

    Runs are found within tiles first; only these few rows are put in order over a whole part.
    """
    tiled = frame.withColumn("__tile", F.floor(F.col("pos") / TILE))
    w = Window.partitionBy(*part, "__tile").orderBy("pos")
    before = F.lag("pos").over(w)
    marked = tiled.withColumn("__near", F.col("pos") - before <= 1 if contiguous else F.when(before.isNotNull(), F.lit(True)))
    # the first row of a tile can't see the one before it, so it is a run of its own for now
    change = F.lag("__near").over(w).isNull() | (F.col("__near") != F.lag("__near").over(w)) | ~F.col(key).eqNullSafe(F.lag(key).over(w))
    marked = marked.withColumn("__run", island([*part, "__tile"], ["pos"], change))
    local = marked.groupBy(*part, "__tile", "__run").agg(F.min("pos").alias("st"), F.max("pos").alias("end"), F.first(key).alias(key), F.first("__near").alias("__near"), *[f.alias(c) for c, (f, _) in aggs.items()])
    order = Window.partitionBy(*part).orderBy("st")
    near = F.coalesce("__near", F.col("st") - F.lag("end", 1, 0).over(order) <= 1) if contiguous else F.lit(True)
    joined = local.withColumn("__near", near)
    change = F.lag("st").over(order).isNull() | (F.col("__near") != F.lag("__near").over(order)) | ~F.col(key).eqNullSafe(F.lag(key).over(order))
    joined = joined.withColumn("__whole", island(part, ["st"], change))
    return joined.groupBy(*part, "__whole").agg(F.min("st").alias("st"), F.max("end").alias("end"), F.first(key).alias(key), *[g(F.col(c)).alias(c) for c, (_, g) in aggs.items()]).drop("__whole")


class Fold(NamedTuple):
    """How values of a run combine from left to right, and the functions of what comes from the left that rows make.

    step: the value so far and the next one; nothing: the function of no rows; then: a function and the next row's value;
    apply: a function and a value from the left.
    """

    step: Callable[[Column, Column], Column]
    nothing: Callable[[], Column]
    then: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column], Column]


ADD = Fold(lambda x, y: x + y, lambda: F.lit(0).cast("long"), lambda f, y: f + y, lambda f, x: x + f)
MOST = Fold(F.greatest, lambda: F.lit(None).cast("long"), F.greatest, lambda f, x: F.greatest(x, f))


def merge_intervals(frame: DataFrame, part: list[str], distance: int | None, joins: Callable[[Callable[[str], Column]], Column] | None = None, fold: dict[str, Fold] | None = None) -> DataFrame:
    """Joins neighbours (st, end) in ascending order of st (then ``ord``) whose gap is at most ``distance``, if one is given.

    ``joins`` gets a function from a column's name to its value on the row before and says whether the
    rows may join; ``fold`` gives, for each further column, how its values combine
    from left to right (others keep the first row's).  The end is the last row's.

    Runs are found within tiles of the axis first, each with the folded value of its own rows, and the first run of a tile also as a function of the
    value from the left.  Only the first and the last run of each tile then meet over a whole part, where these functions are applied; no row
    or group holds more than one tile's intervals, or two runs a tile.
    """
    fold, rest = fold or {}, [c for c in frame.columns if c not in (*part, "st", "end", "ord")]

    def starts(before: Callable[[str], Column]) -> Column:
        near = F.lit(True) if distance is None else F.col("st") - before("end") <= distance
        return F.coalesce(~(near & joins(before) if joins is not None else near), F.lit(True))

    tile = [*part, "__tile"]
    local, whole_tile = Window.partitionBy(*tile).orderBy("st", "ord"), Window.partitionBy(*tile)
    first_row = F.row_number().over(local) == 1
    tiled = frame.withColumn("__tile", F.floor(F.col("st") / TILE))
    tiled = tiled.withColumn("__new", first_row | starts(lambda c: F.lag(c).over(local))).withColumn("__run", island(tile, ["st", "ord"], F.col("__new")))
    packed = tiled.groupBy(*tile, "__run").agg(F.array_sort(F.collect_list(F.struct("st", "ord", "end", *rest))).alias("rows"))
    first, later = F.col("rows")[0], F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    over_rows = lambda rows, start, f, c: F.aggregate(rows, start, lambda acc, row: f(acc, row[c]))
    values = {c: over_rows(later, first[c], fold[c].step, c) if c in fold else first[c] for c in rest}
    functions = F.struct(F.lit(True).alias("any"), *[over_rows("rows", f.nothing(), f.then, c).alias(c) for c, f in fold.items()])
    # names of the run's first row, so that ``joins`` finds them; its last row, values and functions beside
    runs = packed.select(
        *tile, "__run", *[first[c].alias(c) for c in ("st", "ord", "end", *rest)], F.element_at("rows", -1).alias("__last"),
        F.struct(F.lit(True).alias("any"), *[v.alias(c) for c, v in values.items()]).alias("__values"), F.when(F.col("__run") == 1, functions).alias("__functions"),
    )
    # a run inside a tile is whole and stays by itself
    inside = (F.col("__run") > 1) & (F.col("__run") < F.max("__run").over(whole_tile))
    runs = runs.withColumn("__inside", inside).withColumns({"__t": F.when(F.col("__inside"), F.col("__tile")), "__r": F.when(F.col("__inside"), F.col("__run"))})
    group = [*part, "__t", "__r"]
    order = Window.partitionBy(*group).orderBy("__tile", "__run")
    runs = runs.withColumn("__new", (F.col("__run") > 1) | starts(lambda c: F.lag(F.col("__last")[c]).over(order)))
    runs = runs.withColumn("__whole", island(group, ["__tile", "__run"], F.col("__new")))
    chained = runs.groupBy(*group, "__whole").agg(F.array_sort(F.collect_list(F.struct("__tile", "__run", "st", "ord", "__last", "__values", "__functions"))).alias("rows"))
    over_runs = lambda f, c: F.aggregate(later, first["__values"][c], lambda acc, run: f.apply(run["__functions"][c], acc))
    joined = {c: over_runs(fold[c], c) if c in fold else first["__values"][c] for c in rest}
    out = {"st": first["st"], "end": F.element_at("rows", -1)["__last"]["end"], "ord": first["ord"], **joined}
    return chained.select(*part, *[v.alias(k) for k, v in out.items()])


def subtract_pieces(st: Column, end: Column, others: Column) -> Column:
    """What is left of (st, end) without the intervals in ``others`` (array<struct<st, end>>), as such an array.

    An interval inside another one leaves nothing.
    """
    kind = "struct<at:bigint,pieces:array<struct<st:bigint,end:bigint>>>"
    start = F.struct(st.cast("long").alias("at"), F.array().cast("array<struct<st:bigint,end:bigint>>").alias("pieces")).cast(kind)

    def step(acc, o):
        piece = F.struct(acc["at"].alias("st"), F.least(o["st"], end).cast("long").alias("end"))
        more = F.when(piece["end"] > piece["st"], F.concat(acc["pieces"], F.array(piece))).otherwise(acc["pieces"])
        return F.struct(F.greatest(acc["at"], o["end"].cast("long")).alias("at"), more.alias("pieces")).cast(kind)

    def finish(acc):
        tail = F.struct(acc["at"].alias("st"), end.cast("long").alias("end"))
        return F.when(acc["at"] < end, F.concat(acc["pieces"], F.array(tail))).otherwise(acc["pieces"])

    return F.aggregate(F.array_sort(others), start, step, finish)


def subtract(frame: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """``frame`` (with st, end) without the parts that ``others`` (keys, st, end) cover; untouched intervals stay as they are."""
    cut = others.select(*keys, F.col("st").alias("__st"), F.col("end").alias("__end")).distinct()
    # what is cut off depends on the range alone, so no row needs a number of its own
    met = range_join(frame.select(*keys, "st", "end").distinct(), cut, keys, ("st", "end"), ("__st", "__end"))
    hit = met.groupBy(*keys, "st", "end").agg(F.collect_set(F.struct(F.col("__st").alias("st"), F.col("__end").alias("end"))).alias("__cuts"))
    met = frame.join(hit, [*keys, "st", "end"], "left")
    pieces = F.when(F.col("__cuts").isNull(), F.array(F.struct(F.col("st").cast("long").alias("st"), F.col("end").cast("long").alias("end")))).otherwise(subtract_pieces(F.col("st"), F.col("end"), F.col("__cuts")))
    made = met.withColumn("__piece", F.explode(pieces))
    return made.select(*[F.col(f"__piece.{c}").alias(c) if c in ("st", "end") else F.col(c) for c in frame.columns])
