"""Exact k-means on integer vectors by sort-means.

In each round every centroid lists the others by their distance from it. A vector scans its previous centroid's list and stops at the first centroid strictly more than twice
as far from that centroid as the vector is: it and all after it are strictly farther from the vector than its previous centroid. All sums and squares are whole numbers: in doubles
where these are exact, in Python's integers where components are too large for that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, drop
from nearfield.llm.knn_join import _matrix, integer_vectors

SCALE, WIDTH, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, "3"
LONG = 2**63 - 1
#: Bits of a limb, in which totals of any size are summed by Spark; places of the count and of the inertia among a cluster's totals.
LIMB, COUNT, INERTIA = 40, -1, -2

_STATE = "vec_id long, v array<double>, cluster int, distance long, dim int, limb int, total long"


class Centroids:
    """Integer centroids with, for each, the others in order of distance from it."""

    def __init__(self, at: list[list[int]]) -> None:
        self.at, k = at, len(at)
        most = max((abs(x) for c in at for x in c), default=0)
        #: below this all squared distances of vectors and centroids are exact in doubles
        self.exact = 2.0 ** ((51 - max(len(at[0]), 1).bit_length()) // 2)
        self.small = most < self.exact
        self.matrix = np.array(at, np.float64) if self.small else None
        self.order, self.apart = [], []
        for c in range(k):
            apart = self.squared(self.matrix, c) if self.small else [sum((a - b) ** 2 for a, b in zip(self.at[c], o, strict=True)) for o in at]
            near = sorted((j for j in range(k) if j != c), key=lambda j, apart=apart: (apart[j], j))
            self.order.append(near)
            self.apart.append([apart[j] for j in near])

    def squared(self, v: np.ndarray, c: int) -> np.ndarray:
        """Exact squared distances of the rows to a centroid: doubles, or integers as objects beyond their range."""
        if self.small and (not v.size or np.abs(v).max() < self.exact):
            d = v - self.matrix[c]
            return np.einsum("ij,ij->i", d, d)
        return np.array([sum((int(x) - y) ** 2 for x, y in zip(row, self.at[c], strict=True)) for row in v.tolist()] + [None], object)[:-1]

    def nearest(self, v: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centroid (ties: the smaller number) and its squared distance, scanned from the previous one."""
        own = previous.astype(np.int64)
        best = np.zeros(len(v), np.float64 if self.small and (not v.size or np.abs(v).max() < self.exact) else object)
        for c in np.unique(own).tolist():
            rows = np.flatnonzero(previous == c)
            best[rows] = current = self.squared(v[rows], c)
            for j, apart in zip(self.order[c], self.apart[c], strict=True):
                near = np.asarray(apart <= 4 * current, bool)
                rows, current = rows[near], current[near]
                if not len(rows):
                    break
                d = self.squared(v[rows], j)
                nearer = np.asarray((d < best[rows]) | ((d == best[rows]) & (j < own[rows])), bool)
                own[rows[nearer]], best[rows[nearer]] = j, d[nearer]
        return own, best


def _limbs(n: int):
    """(place, limb) of a whole number."""
    sign, n, place = (-1 if n < 0 else 1), abs(n), 0
    while n:
        yield place, sign * (n & ((1 << LIMB) - 1))
        n, place = n >> LIMB, place + 1


_KINDS = {"vec_id": pa.int64(), "v": pa.list_(pa.float64()), "cluster": pa.int32(), "distance": pa.int64(), "dim": pa.int32(), "limb": pa.int32(), "total": pa.int64()}


def _batch(n: int, **columns) -> pa.RecordBatch:
    """A batch of the state's columns, null where not given."""
    full = [pa.nulls(n, kind) if name not in columns else columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], kind) for name, kind in _KINDS.items()]
    return pa.RecordBatch.from_arrays(full, list(_KINDS))


def _assign(centroids: Centroids):
    """Rows with their nearest centroids, and after them the task's totals of each cluster: count, inertia and the sum of each component, in limbs."""

    def of(batches):
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v, before = _matrix(b.column("v")), b.column("cluster").to_numpy(zero_copy_only=False)
            large = np.abs(v).max(axis=1, initial=0) >= centroids.exact
            own, d = np.zeros(len(v), np.int64), np.zeros(len(v), object)
            for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
                if len(rows):
                    own[rows], best = centroids.nearest(v[rows], before[rows])
                    d[rows] = [int(x) for x in best.tolist()]
            for c in np.unique(own).tolist():
                rows = own == c
                few, many = v[rows & ~large].sum(axis=0), v[rows & large].tolist()
                sums = [int(x) + sum(int(r[i]) for r in many) for i, x in enumerate(few.tolist())]
                for dim, n in [(COUNT, int(rows.sum())), (INERTIA, sum(d[rows].tolist())), *enumerate(sums)]:
                    total[c, dim] = total.get((c, dim), 0) + n
            yield _batch(len(v), vec_id=b.column("vec_id"), v=b.column("v"), cluster=own, distance=[min(x, LONG) for x in d.tolist()])
        flat = [(c, dim, place, x) for (c, dim), n in total.items() for place, x in _limbs(n)]
        if flat:
            yield _batch(len(flat), **dict(zip(("cluster", "dim", "limb", "total"), zip(*flat, strict=True), strict=True)))

    return of


def _totals(table: DataFrame) -> dict[tuple[int, int], int]:
    """(cluster, component) -> exact total over all tasks; clusters x components numbers."""
    limbs = table.where("dim is not null").groupBy("cluster", "dim", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("n")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in limbs:
        out[r.cluster, r.dim] = out.get((r.cluster, r.dim), 0) + (int(r.n) << (LIMB * r.limb))
    return out


def sort_means(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of width components, floor(scale * x) each.

    vectors: vec_id, embedding; further columns are ignored. Vectors that are null, of another length or hold a null or a component that is not finite (as it is or scaled) are left out.
    Centroids start as the k vectors with the smallest sha256 of "seed:vec_id", ties by vector, fewer where there are fewer vectors; each round assigns every vector to the nearest centroid (ties: the
    smaller number) and moves every centroid that has vectors to floor(sum / count); then vectors are assigned once more. Rows with a null vec_id are clustered but start no centroid, so that a
    table of these alone has no clusters and gives no rows; repeated vec_ids are rows of their own. Distances and inertias are exact; those that a long does not hold are given as the greatest long.
    Runs jobs: one pass a round, whose table holds the vectors with their clusters; of each cluster the totals alone, k * (width + 2) numbers, go to the driver.
    The result's attribute centroids has the final centroids.
    """
    data = integer_vectors(vectors.where(F.size("embedding") == width), scale, null_ids=True)
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = data.where("vec_id is not null").orderBy(by, "vec_id", "v").limit(k).collect()
    if not first:
        out = data.limit(0).selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
        out.centroids = []
        return out
    centroids = Centroids([[int(x) for x in r.v] for r in first])
    state, table = data.withColumn("cluster", F.lit(0)), None
    for r in range(rounds + 1):
        before, table = table, cut(state.mapInArrow(_assign(centroids), _STATE), "assigned")
        if before is not None:
            drop(before)
        total, state = _totals(table), table.where("dim is null").select("vec_id", "v", "cluster")
        if r == rounds:
            break
        moved = [[total.get((c, i), 0) // total[c, COUNT] for i in range(width)] if (c, COUNT) in total else at for c, at in enumerate(centroids.at)]
        if moved == centroids.at:  # later rounds would repeat this one
            break
        centroids = Centroids(moved)
    inertia = [total.get((c, INERTIA), 0) for c in range(len(centroids.at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.at]
    of = [(c, min(inertia[c], LONG), min(sum(inertia), LONG), digest[c]) for c in range(len(digest))]
    of = F.broadcast(vectors.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    out = table.where("dim is null").select("vec_id", "cluster", "distance").join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    out.centroids = centroids.at
    return out
