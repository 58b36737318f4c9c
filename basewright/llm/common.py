"""Shared folders, lineage cuts, column names and order-preserving distribution."""

from __future__ import annotations

import re
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh, shared_dir, written  # noqa: F401


class Scratch:
    """Tables that one job writes to the shared folder on its way; ``drop`` deletes those that nothing will read again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh(self.spark, label)
        out = written(df, label, path)
        self.held.append((out, path))
        return out

    def drop(self, *gone: DataFrame, but: tuple[DataFrame, ...] = ()) -> None:
        """Deletes the given tables, or all but some.  Only for tables whose readers have all been written themselves."""
        going = [x for x in self.held if any(x[0] is y for y in gone) or not gone and not any(x[0] is y for y in but)]
        for _, where in going:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.held = [x for x in self.held if not any(x is y for y in going)]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column of the frame has it (whatever the case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def set_aside(df: DataFrame, *made: str) -> DataFrame:
    """``df`` with its own columns of these names called ``<name>_input`` (and more underscores while that is
    taken), so that an operator's columns can have them."""
    for name in made:
        for c in df.columns:
            if c.lower() == name.lower():
                df = df.withColumnRenamed(c, free_name(df, f"{c}_input"))
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_in_order(df: DataFrame, id_col: str, tie_col: str, n: int, descending: bool = False) -> tuple[F.Column, int]:
    """Number of the task that a row goes to, and how many tasks there are: about n runs of about equal length in the
    order of a whole-number id (nulls last) and, among equal ids, of a 64-bit hash.

    Ids that are several runs long (and nulls) are cut by the hash; only rows that are equal in both share a task
    whatever their number.  Reads the id alone; the driver gets n numbers.
    """
    got = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], 10_000).alias("cuts"), F.count("*").alias("rows"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
    every = sorted(got["cuts"] or []) if n > 1 else []
    cuts = sorted(set(every))
    # an id that is a cut k times over has about k runs of its own behind the lesser ids of its run
    parts = {c: k for c in cuts if (k := every.count(c)) > 1}
    share = lambda k: F.least(F.floor((F.col(tie_col) / F.lit(2.0**64) + 0.5) * k), F.lit(k - 1)).cast("int")
    at, first = [], 0
    for c in [*cuts, None]:
        at.append(first)
        first += 1 + parts.get(c, 0)
    nulls = -(-got["nulls"] * n // max(1, got["rows"])) or 1
    starts = F.array(*map(F.lit, at))
    out = F.element_at(starts, _bisect(cuts, F.col(id_col)) + 1)
    for c, k in parts.items():
        run = at[cuts.index(c)]
        # in a run, ids below the frequent one come first, or last where the order is descending
        if descending:
            out = F.when(F.col(id_col) == c, F.lit(run + k) - share(k)).otherwise(out)
        else:
            out = F.when(F.col(id_col) == c, F.lit(run + 1) + share(k)).otherwise(out)
    if descending:
        out = F.lit(first - 1) - out
    return F.when(F.col(id_col).isNull(), F.lit(first) + share(nulls)).otherwise(out).cast("int"), first + nulls


def _bisect(cuts: list, x: F.Column, low: int = 0) -> F.Column:
    """How many of the cuts are below x, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(x <= F.lit(cuts[mid]), _bisect(cuts[:mid], x, low)).otherwise(_bisect(cuts[mid + 1 :], x, low + mid + 1))


#: Bytes of an Arrow batch on its way to Python or back.
BATCH_BYTES = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The frame itself, after bounding its session's Arrow batches: Spark's own bound is 64 MB, of which a task holds
    several copies on either side.  A smaller bound of the session's stays."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def at_rest(*caches: dict) -> None:
    """Empties a worker's caches and returns its free memory; workers outlive the stage."""
    import pyarrow as pa

    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()


def text_hash(col: str = "text") -> F.Column:
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def spread_join(rows: DataFrame, groups: DataFrame, key: list[str], count: str, row_id: F.Column, inner: bool = False, hot_groups: int = 200, total: int | None = None) -> DataFrame:
    """``rows`` left (or inner) joined with ``groups`` (one row a key, with its number of rows), hot keys spread.

    A key with more than 1 / hot_groups of all counted rows is hot.  There are fewer
    than hot_groups of those, so they are broadcast; rows with a hot key are dealt
    out by ``row_id`` instead of the key.  All other keys meet in a shuffle.
    ``total``: the sum of all counts, where it is known.
    Null keys never match.
    """
    if total is None:
        total = groups.agg(F.sum(count)).first()[0] or 0
    others = [c for c in groups.columns if c not in key]
    hot = groups.filter(F.col(count) > max(1000, total / hot_groups))
    named = hot.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"__hot_{c}") for c in others], F.lit(True).alias("__hot"))
    on = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(key)]
    marked = rows.join(F.broadcast(named), on, "left").drop(*[f"__k{i}" for i in range(len(key))])
    is_hot = F.col("__hot").isNotNull()
    marked = marked.withColumn("__salt", F.when(is_hot, row_id).otherwise(F.lit(0)).cast("long"))
    for i, c in enumerate(key):
        marked = marked.withColumn(f"__m{i}", F.when(~is_hot, F.col(c)))
    cold = groups.filter(F.col(count) <= max(1000, total / hot_groups)).select(*[F.col(c).alias(f"__m{i}") for i, c in enumerate(key)], F.lit(0).cast("long").alias("__salt"), *[F.col(c).alias(f"__cold_{c}") for c in others], F.lit(True).alias("__cold"))
    out = marked.join(cold, ["__salt", *[f"__m{i}" for i in range(len(key))]], "left")
    if inner:
        out = out.filter(is_hot | F.col("__cold").isNotNull())
    return out.select(*rows.columns, *[F.when(is_hot, F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")).alias(c) for c in others])


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@contextmanager
def opened(uri: str, mode: str):
    """A file in the shared folder, from an executor."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) if mode == "w" else system.open_input_file(path) as f:
        yield f


#: Rows of at most two whole-number columns that may be broadcast: 2 ** 20 of them take some 50 MB.
BROADCAST_ROWS = 1 << 20


def small_or_shuffled(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint where it was counted to be small; beyond that the join shuffles."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def _loose(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges (a, b), b < a, and whether they are anything but stars about each component's smallest id."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    at = ends.groupBy("v").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    rows, open_ends = at.agg(F.sum("below"), F.count_if(F.col("below") + F.col("above") > 1)).first()
    return rows or 0, open_ends > 0


def components(edges: DataFrame, before: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Rows (id, component): each vertex of the edges (a, b) and the smallest id it is connected with.

    Alternating large-star and small-star steps, each a grouped minimum and a join
    with it, until all edges are stars; every step is written to the shared folder, which
    loses it when the next one is there.
    ``before``: the components of earlier edges, which then need not be given again;
    the new edges are taken between those components.  ``scratch`` takes the table that the result reads.
    """
    if before is not None:
        for end in "ab":
            edges = edges.join(small_or_shuffled(before.toDF(end, f"c{end}")), end, "left")
        edges = edges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while (shape := _loose(edges))[1]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        large = spread_join(both, low, ["a"], "n", F.xxhash64("b"), inner=True, total=2 * shape[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = scratch.written(large, "large-star")
        scratch.drop(edges)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = spread_join(large, low, ["a"], "n", F.xxhash64("b"), inner=True, total=large.count())
        small = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = scratch.written(small, "small-star")
        scratch.drop(large)
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    if before is None:
        return found
    moved = before.join(small_or_shuffled(found.toDF("component", "now")), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return moved.unionByName(found).distinct()
