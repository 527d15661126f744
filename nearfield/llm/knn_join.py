"""Exact k nearest neighbours by inner product: a Voronoi join.

Vectors are grouped by their nearest pivot. A summary of each group (its radius, its greatest norm and the distances of its k + 1 vectors nearest to the pivot)
gives, for every query, a score that at least k vectors reach, and for every group of data the most that one of its vectors can score with it. A query goes to the groups
that its bound lets in and no others, and a group's data go to the blocks of queries that have such a query; each block and part of a group is solved alone, and the best are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import cut

SCALE = 256
#: Queries of a block and vectors of a part of a group, about; pivots are at least and at most so many; rows whose bounds are computed at once.
BLOCK_QUERIES, PART_VECTORS, PIVOTS, BOUND_ROWS = 512, 32768, (8, 1024), 256
#: Integers are exact in double precision below this; scores are given as a long's least or greatest value beyond it.
EXACT, LONG = float(2**53), 2**63 - 1


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def integer_vectors(vectors: DataFrame, scale: int = SCALE, null_ids: bool = False) -> DataFrame:
    """(vec_id, v array<double>) with floor(scale * x), which is an integer, of each component of vectors (vec_id, embedding).

    Vectors that are null or empty or hold a null or a component that is not finite, as it is or scaled, take no part, nor do rows with a null vec_id unless null_ids.
    """
    scaled = F.transform("embedding", lambda e: e.cast("double") * scale)
    good = (F.col("vec_id").isNotNull() | F.lit(null_ids)) & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("embedding", lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) < float("inf")), F.lit(False)))
    # beyond 2**52 all doubles are integers, and a long would end at 2**63
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < float(2**52), F.floor(y).cast("double")).otherwise(y))
    return vectors.select("vec_id", "embedding").where(good).where(fine).select("vec_id", whole.alias("v"))


def one_length(data: DataFrame) -> DataFrame:
    """data (vec_id, v) with zeros after shorter vectors, so that a component that only one of two vectors has adds nothing to their score."""
    least, most = data.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    return data if least == most else data.select("vec_id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v"))).alias("v"))


def _scores(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the rows in floating point, and how far each row of q may be off: nothing where all sums stay exact."""
    width, q_most, d_most = max(1, q.shape[1]), np.abs(q).max(axis=1, initial=0), np.abs(d).max(initial=0)
    if q_most.max(initial=0) > 1e140 or d_most > 1e140:  # products of these would leave the range of a double
        q, d, q_most, d_most = q.astype(np.longdouble), d.astype(np.longdouble), q_most.astype(np.longdouble), np.longdouble(d_most)
    bound = q_most * d_most * width
    return q @ d.T, np.where(bound < EXACT, 0, bound * (width + 2) * 2.0**-52)


def _top(score: np.ndarray, off: float, ids: np.ndarray, k: int, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Columns of the k best of one row and their exact scores, ties to the smaller id."""
    near = np.arange(len(score))
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - 2 * off)
    if off:
        own = [int(x) for x in q]
        exact = [sum(a * int(b) for a, b in zip(own, d[j], strict=True)) for j in near]
        best = sorted(range(len(near)), key=lambda i: (-exact[i], ids[near[i]]))[:k]
        return near[best], [exact[i] for i in best]
    best = near[np.lexsort((ids[near], -score[near]))][:k]
    return best, score[best].astype(np.int64).tolist()


def _beyond(score: int) -> str | None:
    """Text that sorts as the score does where a long does not hold it; null for all others."""
    if abs(score) < LONG:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):04}{digits}"
    return f"{9999 - len(digits):04}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


class _Groups:
    """Pivots and the summaries of the groups around them; the number of pivots is bounded."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots, self.radius, self.norm, self.near = pivots.astype(np.float64), None, None, None

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row and the distance to it."""
        x = v.astype(np.float64)
        d2 = np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(1), 0)
        own = d2.argmin(axis=1)
        return own, np.linalg.norm(x - self.pivots[own], axis=1)

    def slack(self, norm: np.ndarray) -> np.ndarray:
        """(queries, groups): more than rounding can take from a bound."""
        reach = np.linalg.norm(self.pivots, axis=1) + np.where(np.isfinite(self.radius), self.radius, 0)
        return 1e-6 + 1e-10 * norm[:, None] * reach

    def least(self, q: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that k vectors other than its own reach, or minus infinity."""
        x = q.astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        at = x @ self.pivots.T - self.slack(norm)
        low = (at[:, :, None] - norm[:, None, None] * self.near[None]).reshape(len(x), -1)
        if low.shape[1] <= k:
            return np.full(len(x), -np.inf)
        low = np.where(np.isnan(low), -np.inf, low)
        got = -np.partition(-low, k, axis=1)[:, k]  # one more, as one may be the query's own row
        return np.where(np.isfinite(got), got, -np.inf)

    def most(self, q: np.ndarray) -> np.ndarray:
        """(queries, groups): no vector of the group scores more; not a number where that is beyond doubles."""
        x = q.astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        return np.minimum(x @ self.pivots.T + norm[:, None] * self.radius, norm[:, None] * self.norm) + self.slack(norm)

    def wanted(self, q: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the groups that may hold one of its k best."""
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(q), BOUND_ROWS):
                rows = q[at : at + BOUND_ROWS]
                out += [np.flatnonzero(~low & (self.radius >= 0)) for low in self.most(rows) < self.least(rows, k)[:, None]]
        return out


def knn_join(vectors: DataFrame, is_query, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with the rows of other vec_ids (all, if fewer), ties to the smaller vec_id.

    vectors: vec_id, embedding; is_query: a condition on vec_id. Rows that integer_vectors() leaves out take no part; shorter vectors end in zeros.
    Repeated vec_ids are rows of their own among the data and one query each; equal vectors are ties. Bounds and scores are exact whatever the size of the components;
    a score that a long does not hold is given as the nearest long. The result's attribute routes has the blocks of queries and the groups that each was sent to.
    """
    data = cut(one_length(integer_vectors(vectors, scale)), "vectors")
    queries = data.where(is_query).dropDuplicates(["vec_id"])
    n, n_queries = data.count(), queries.count()
    if not n or not n_queries:
        return data.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    n_pivots = min(max(PIVOTS[0], math.ceil(n_queries / BLOCK_QUERIES)), PIVOTS[1])
    picked = data.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(n_pivots).collect()
    groups = _Groups(np.unique(np.array([r.v for r in picked]), axis=0))
    width = len(groups.pivots)

    def summarise(batches):
        """Each task's part of the summaries: of each group the radius, norm and the nearest vectors."""
        radius, norm, near = np.full(width, -1.0), np.zeros(width), np.full((width, k + 1), np.inf)
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"))
                own, dist = groups.assign(v)
                np.maximum.at(radius, own, dist)
                np.maximum.at(norm, own, np.linalg.norm(v, axis=1))
                for g in np.unique(own):
                    near[g] = np.sort(np.concatenate([near[g], dist[own == g]]))[: k + 1]
        full = np.flatnonzero(radius >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(radius[full]), pa.array(norm[full]), pa.array(list(near[full]), pa.list_(pa.float64()))], ["g", "radius", "norm", "near"])

    parts = data.mapInArrow(summarise, "g long, radius double, norm double, near array<double>")
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1)
    groups.radius, groups.norm, groups.near = np.full(width, -np.inf), np.full(width, -np.inf), np.full((width, k + 1), np.inf)
    for r in parts.groupBy("g").agg(F.max("radius").alias("radius"), F.max("norm").alias("norm"), nearest.alias("near")).collect():  # a row per pivot
        groups.radius[r.g], groups.norm[r.g], groups.near[r.g, : len(r.near)] = r.radius, r.norm, r.near

    def bounded(batches):
        """Queries with their own group and the groups that must be searched for them."""
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"))
                own, _ = groups.assign(v)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(own), pa.array(groups.wanted(v, k), pa.list_(pa.int64()))], ["query_id", "q", "home", "g"])

    def assigned(batches):
        for b in batches:
            if b.num_rows:
                own, _ = groups.assign(_matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(own)], ["vec_id", "v", "g"])

    data = data.mapInArrow(assigned, "vec_id long, v array<double>, g long")
    # a row per pivot: of how many parts a group is, and how many blocks its queries make
    shape = data.groupBy("g").agg(F.ceil(F.count("*") / PART_VECTORS).cast("long").alias("parts"))
    asked = cut(queries.mapInArrow(bounded, "query_id long, q array<double>, home long, g array<long>"), "queries")
    homes = asked.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("long").alias("blocks"))
    asked = asked.join(homes, "home").withColumn("block", F.concat_ws("-", "home", F.pmod(F.xxhash64("query_id"), F.col("blocks"))))
    asked = asked.select("block", "query_id", "q", F.explode("g").alias("g")).join(shape, "g")
    routes = cut(asked.select("block", "g", "parts").distinct(), "routes")
    sent = data.join(routes, "g").select("block", "g", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "vec_id", "v")
    copies = asked.select("block", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "query_id", "q")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            q, d, query_ids, ids = _matrix(left.column("q")), _matrix(right.column("v")), left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
            for at in range(0, len(q), 64):
                score, off = _scores(q[at : at + 64], d)
                for i, query in enumerate(query_ids[at : at + 64]):
                    other = np.flatnonzero(ids != query)
                    best, exact = _top(score[i, other], off[i], ids[other], k, q[at + i], d[other] if off[i] else d)
                    out[0] += [query] * len(best)
                    out[1] += ids[other[best]].tolist()
                    out[2] += exact
        columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([min(max(x, -LONG), LONG) for x in out[2]], pa.int64()), pa.array([_beyond(x) for x in out[2]], pa.string())]
        return pa.table(columns, ["query_id", "vec_id", "score", "beyond"])

    near = copies.groupBy("block", "g", "part").cogroup(sent.groupBy("block", "g", "part")).applyInArrow(solve, "query_id long, vec_id long, score long, beyond string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id"))
    out = near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out.routes = routes
    return out
