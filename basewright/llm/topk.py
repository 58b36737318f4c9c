"""Exact top-k search by inner product with pivot-table elimination.

Distances to many pivots are computed once for every vector and written with it.  By the
triangle inequality |q - x| is at least the largest |d(q, p) - d(x, p)|, which bounds the
inner product (|q|^2 + |x|^2 - |q - x|^2) / 2 from above.  A query takes its
candidates in descending order of that bound and stops where the bound falls
below its k-th best score; what remains can't enter the result, whatever the
pivots are.  Pivots are the mutually farthest of a bounded sample; the result doesn't depend on them.

Queries and candidates are dealt into blocks of bounded size by hash.  Each query first meets one
block, whose k-th score is its threshold from then on, then every other block; each query's best k
of all blocks are merged.  No row is dropped and no group grows with the input.  Column ``evaluated``
says how many candidates' scores were computed for a query.

Cases: vectors that are null or hold null, NaN or infinite components take no
part; vectors meet those of their own length only; ties go to the smaller id;
repeated ids are rows of their own, each a query and a candidate of the others; null ids take no part; a query with
fewer candidates returns all; scores are exact whatever the components' size (one beyond a long ranks by its
exact value and is shown as the nearest long); columns other than id and vector aren't read; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Pivots for each length of vector, out of a sample of so many vectors, for the so many most frequent lengths
#: (vectors of other lengths have no pivots, and all their candidates are scored).
PIVOTS, SAMPLE, LENGTHS = 256, 1024, 16
#: Bytes of a block's vectors and distances.
QUERY_BYTES, CANDIDATE_BYTES = 4 << 20, 16 << 20
#: Candidates whose scores are computed between two looks at the bound.
CHUNK = 512
LONG = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, v: array<double>) that take part."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def kind_for(top: float, scale: float, dim: int):
    """Numbers whose inner products are exact, given the largest component: doubles, else 64-bit, else Python's own."""
    with np.errstate(over="ignore"):
        most = (np.float64(top) * scale + 1) ** 2 * dim
    return np.dtype("f8" if most < 2.0**52 else "i8" if most < 2.0**62 else object)


def whole(x: np.ndarray, scale: float, kind: np.dtype) -> np.ndarray:
    """floor(scale * x)."""
    if kind != object:
        return np.floor(x * scale).astype(kind)
    out = [math.floor(t * scale) if math.isfinite(t * scale) else int(t) * int(scale) for t in x.reshape(-1).tolist()]
    return np.array(out, dtype=object).reshape(x.shape)


def distances(z: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row to every pivot, as floats; NaN, which bounds nothing, where a float can't hold it."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = (z**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * z @ pivots.T
        d = np.sqrt(np.maximum(square, 0)).astype("f4")
    d[~np.isfinite(d)] = np.nan
    return d


def farthest(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the farthest from those before it."""
    picked, near = [0], np.full(len(sample), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        while len(picked) < min(n, len(sample)):
            near = np.minimum(near, np.nan_to_num(((sample - sample[picked[-1]]) ** 2).sum(1), nan=0.0))
            picked.append(int(near.argmax()))
    return sample[picked]


def search_block(q_rows, fq, q, dq, q_least, x_rows, x_ids, fx, x, dx, k):
    """Each query's place, best k of the block as (scores, ids), exactly, and how many candidates were scored.

    ``q_least``: scores that the k-th best is known to reach, or -inf; fq and fx: q and x as doubles.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        nq, nx = (fq**2).sum(1), (fx**2).sum(1)
        dx = np.ascontiguousarray(dx.T)
        near = np.empty(len(x), "f4")
    for i in range(len(q)):
        with np.errstate(over="ignore", invalid="ignore"):
            near[:] = 0
            for d, own in zip(dx, dq[i]):
                np.maximum(near, np.abs(d - own), out=near)
            # distances are floats of squares in double; the slack is far above both roundings
            slack = 1e-6 * (np.sqrt(nq[i]) + np.sqrt(nx) + 2 * dq[i].max(initial=0)) + 1e-3
            low = np.maximum(near.astype("f8") - slack, 0)
            bound = (nq[i] + nx - low**2) / 2 + 1 + 1e-12 * (nq[i] + nx)
        bound[np.isnan(bound)] = np.inf
        open_rows = np.flatnonzero(bound >= q_least[i])
        order = open_rows[np.argsort(-bound[open_rows], kind="stable")]
        best, scored = ([], []), 0
        for at in range(0, len(order), CHUNK):
            if len(best[0]) == k and bound[order[at]] < best[0][-1]:
                break
            part = order[at : at + CHUNK]
            part = part[x_rows[part] != q_rows[i]]
            scored += len(part)
            scores, ids = [*best[0], *(x[part] @ q[i]).tolist()], [*best[1], *x_ids[part].tolist()]
            top = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k] if len(ids) < 4 * k else _top(scores, ids, k)
            best = [scores[j] for j in top], [ids[j] for j in top]
        yield i, best, scored


def _top(scores: list, ids: list, k: int) -> list[int]:
    least = sorted(scores, reverse=True)[k - 1]
    return sorted((j for j, s in enumerate(scores) if s >= least), key=lambda j: (-scores[j], ids[j]))[:k]


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score, evaluated): queries are the rows whose id is divisible by ``every``, candidates all other rows.

    Components become floor(scale * x); scale is a power of two.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = usable(small_batches(vectors), id_col, vec_col).withColumn("dim", F.size("v"))
    sizes = scratch.written(rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("nq"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")), "topk-sizes")
    frequent = [r["dim"] for r in sizes.filter("nq > 0 and dim > 0").orderBy(F.col("n").desc(), "dim").limit(LENGTHS).collect()]
    sampled = rows.filter(F.col("dim").isin(frequent)).withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "v"))).filter(F.col("r") <= SAMPLE) if frequent else rows.limit(0)
    got: dict[int, list] = {}
    for r in sampled.select("dim", "v").collect():  # SAMPLE * LENGTHS rows at most
        got.setdefault(r["dim"], []).append(r["v"])
    with np.errstate(over="ignore"):
        pivots = {dim: farthest(np.floor(np.array(sorted(some)) * scale), PIVOTS) for dim, some in got.items()}

    def measure(batches):
        for b in batches:
            out = []
            for v in b.column(2):
                with np.errstate(over="ignore"):
                    z = np.floor(np.array(v.as_py(), "f8") * scale)
                out.append(distances(z[None], pivots[len(z)])[0].tobytes() if len(z) in pivots else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(v.as_py()) for v in b.column(2)], pa.int32()), pa.array(out, pa.binary())], names=["row", "id", "v", "dim", "d"])

    # written once: the pivot table, with a number for each row
    table = rows.select(F.monotonically_increasing_id().alias("row"), "id", "v").mapInArrow(measure, "row long, id long, v array<double>, dim int, d binary")
    table = scratch.written(table, "pivot-table")
    block = lambda size: F.greatest(F.lit(1), F.floor(F.lit(size) / (F.col("dim") * 8 + 4 * PIVOTS + 64)))
    blocks = lambda n, size: F.ceil(F.col(n) / block(size)).cast("int")
    # one row for each length of vector: bounded by the lengths that occur, a few
    plan = F.broadcast(sizes.filter("nq > 0").select("dim", "top", blocks("nq", QUERY_BYTES).alias("qn"), blocks("n", CANDIDATE_BYTES).alias("xn")))
    placed = table.join(plan, "dim")
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    placed = placed.withColumns({"xb": own("xn"), "qb": F.pmod(F.xxhash64("row", F.lit(1)), F.col("qn")).cast("int")})
    queries = placed.filter(F.col("id") % every == 0).select("dim", "qb", "xb", "xn", "row", "id", "v", "d", "top")
    candidates = placed.select("dim", "xb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qb"), "row", "id", "v", "d").select(*[F.col(c).alias(f"x_{c}") for c in ("dim", "qb", "xb", "row", "id", "v", "d")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            kind = kind_for(left.column("top")[0].as_py(), scale, dim)
            matrix = lambda col: np.array(col.combine_chunks().flatten().to_numpy(zero_copy_only=False), "f8").reshape(len(col), dim)
            table = lambda col: np.frombuffer(b"".join(col.to_pylist()), "f4").reshape(len(col), -1)
            least = np.array([-np.inf if s is None else float(s) - abs(float(s)) * 1e-12 for s in left.column("least").to_pylist()])
            q_rows, x_rows = left.column("row").to_numpy(), right.column("x_row").to_numpy()
            qs, xs = matrix(left.column("v")), matrix(right.column("x_v"))
            with np.errstate(over="ignore"):
                fq, fx = np.floor(qs * scale), np.floor(xs * scale)
            found = search_block(q_rows, fq, whole(qs, scale, kind), table(left.column("d")), least, x_rows, right.column("x_id").to_numpy(), fx, whole(xs, scale, kind), table(right.column("x_d")), k)
            ids = left.column("id").to_pylist()
            for i, (scores, found_ids), scored in found:
                out.append((int(q_rows[i]), ids[i], None, None, None, scored))
                for s, j in zip(scores, found_ids):
                    s = int(s)
                    # what a long can't hold is ranked by its exact digits
                    out.append((int(q_rows[i]), ids[i], j, max(-LONG - 1, min(LONG, s)), None if abs(s) <= LONG else str(s), 0))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, KINDS)], names=[x.split()[0] for x in FOUND.split(", ")])

    def met(left: DataFrame) -> DataFrame:
        return left.groupBy("dim", "qb", "xb").cogroup(candidates.groupBy("x_dim", "x_qb", "x_xb")).applyInArrow(meet, FOUND)

    first = scratch.written(met(queries.withColumn("least", F.lit(None).cast("double"))), "topk-first-block")
    known = first.filter("vec_id is not null").groupBy("row").agg(F.count("*").alias("n"), F.count("digits").alias("long"), F.min("score").alias("least")).filter((F.col("n") >= k) & (F.col("long") == 0)).select("row", F.col("least").cast("double").alias("least"))
    others = queries.join(known, "row", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("xn") - 1))).filter("other <> xb")
    rest = met(others.select("dim", "qb", F.col("other").alias("xb"), "row", "id", "v", "d", "top", "least"))
    sign = F.when(F.col("digits").startswith("-"), -1).when(F.col("digits").isNotNull(), 1).otherwise(0)
    size = F.coalesce(F.length("digits"), F.lit(0))
    by = Window.partitionBy("row")
    order = by.orderBy(F.col("vec_id").isNull(), F.col("score").desc(), (sign * size).desc(), F.when(sign > 0, F.col("digits")).desc(), F.when(sign < 0, F.col("digits")).asc(), "vec_id")
    ranked = first.unionByName(rest).withColumns({"rank": F.row_number().over(order), "evaluated": F.sum("scored").over(by)})
    return ranked.filter(F.col("vec_id").isNotNull() & (F.col("rank") <= k)).select("query_id", "rank", "vec_id", "score", "evaluated")


FOUND = "row long, query_id long, vec_id long, score long, digits string, scored long"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
