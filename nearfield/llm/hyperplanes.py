"""Embedding near-duplicates: sign hashes of random hyperplanes in several tables, exact cosines, connected components.

A table's key is the signs of a vector's products with a few random hyperplanes; vectors that share a key in some table are candidates, and their cosine is computed in double precision.
The number of hyperplanes follows the number of vectors, and the number of tables is such that a pair at the threshold misses all of them with probability MISSED at most. Equal vectors
are one, with a weight. Members of a hot key that lie within half the threshold's angle of one vector, a hub, form its ball: they are linked with each other for certain, so they are
counted by their number and only meet vectors that are not in their ball. A pair that shares several keys counts in the first table alone, so that links are counted without listing pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import components, cut, drop, give_back, run_bounds, whole_runs
from nearfield.llm.minhash import _star, _upto, _whole_runs_of

#: How likely a pair at the threshold may share no table's key; how many vectors a key has, about; of how many on a key is hot, and a block's size.
MISSED, KEY_VECTORS, BLOCK = 1e-6, 512, 1024
#: Members of a hot key that are tried as its hubs; what rounding may take from a cosine by which a ball is drawn; rows of a block that are compared at once.
HUBS, SLACK, ROWS = 4, 1e-9, 256
#: Stands for "in no ball".
NO_BALL = -1
#: Of a row in a run of two blocks: which block it is of, or that the run is of one block alone.
LEFT, RIGHT, ALONE = 0, 1, 2


def tables_for(n: int, least: float) -> tuple[int, int]:
    """Tables and hyperplanes a table for n vectors and a least cosine."""
    planes = min(max(1, math.ceil(math.log2(max(1, n) / KEY_VECTORS))), 48)
    same = (1 - math.acos(min(max(least, -1.0), 1.0)) / math.pi) ** planes
    return (1 if same >= 1 else math.ceil(math.log(MISSED) / math.log1p(-same))), planes


@lru_cache(maxsize=4)
def hyperplanes(count: int, width: int) -> np.ndarray:
    """The normals of the first count hyperplanes, the same on every executor."""
    return np.random.default_rng([1212, width]).standard_normal((count, width))


def unit_rows(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1 in double precision; scaled first, so that no square leaves the range of a double."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _keys(tables: int, planes: int):
    """Each vector with its keys, a number for each table, and the same bits packed."""

    def of(batches):
        powers = 1 << np.arange(planes, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("size").to_numpy()
            for s in np.unique(size).tolist():
                part = b.filter(pa.array(size == s))
                x = unit_rows(part.column("embedding"))
                bits = (x @ hyperplanes(tables * planes, s).T > 0).reshape(len(x), tables, planes)
                keys = bits @ powers
                packed = np.packbits(bits, axis=2).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "copies", "size", "embedding")), pa.array(list(keys), pa.list_(pa.int64())), pa.array([r.tobytes() for r in packed], pa.binary())], ["rep", "copies", "size", "embedding", "keys", "signs"])
        give_back()

    return of


def _to_hubs(least: float):
    """(rep, hub) for each row and each of its key's hubs within half the threshold's angle."""
    half = math.sqrt((1 + least) / 2) + SLACK

    def of(batches):
        for b in batches:
            if not b.num_rows:
                continue
            size, rep, hubs = b.column("size").to_numpy(), b.column("rep").to_numpy(), b.column("hubs")
            a, h = [], []
            for s in np.unique(size).tolist():
                rows = np.flatnonzero(size == s)
                x = unit_rows(b.column("embedding").take(pa.array(rows)))
                mine = hubs.take(pa.array(rows)).flatten()
                y = unit_rows(mine.field("embedding")).reshape(len(rows), HUBS, -1)
                i, j = np.nonzero(np.einsum("ik,ijk->ij", x, y) >= half)
                a.append(rep[rows[i]])
                h.append(mine.field("rep").to_numpy().reshape(len(rows), HUBS)[i, j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(h))], ["rep", "hub"])

    return of


def _linked(x: np.ndarray, signs: np.ndarray, ball: np.ndarray, side: np.ndarray, table: int, least: float):
    """Index pairs of linked rows: their blocks meet here, they share this table's key and no earlier one's, and they aren't in one ball."""
    alone, left = np.flatnonzero(side == ALONE), np.flatnonzero(side == LEFT)
    for a, b in ((alone, alone), (left, np.flatnonzero(side == RIGHT))):
        for k in range(0, len(a) if len(b) else 0, ROWS):
            i, j = np.nonzero(x[a[k : k + ROWS]] @ x[b].T >= least)
            if a is b:
                i, j = i[j > i + k], j[j > i + k]
            i, j = a[i + k], b[j]
            apart = (ball[i] != ball[j]) | (ball[i] == NO_BALL)
            i, j = i[apart], j[apart]
            for m in range(0, len(i), 1 << 14):
                u, v = i[m : m + (1 << 14)], j[m : m + (1 << 14)]
                same = (signs[u, : table + 1] == signs[v, : table + 1]).all(axis=2)
                first = same[:, table] & ~same[:, :table].any(axis=1)
                yield u[first], v[first]


def _met(least: float, tables: int):
    """(a, b, links) for the rows of each run that have links in it: b is the first row reachable by them, links the weight of the linked rows."""

    def of(batches):
        for t in whole_runs(batches, "run"):
            run, rep, copies, side, ball, table, size = (t.column(c).to_numpy() for c in ("run", "rep", "copies", "side", "ball", "table", "size"))
            bounds, out = run_bounds(run), [[], [], []]
            for p, q in zip(bounds[:-1], bounds[1:], strict=True):
                for at, width in sorted(set(zip(table[p:q].tolist(), size[p:q].tolist(), strict=True))):  # one, but where hashes of keys are equal by chance
                    rows = p + np.flatnonzero((table[p:q] == at) & (size[p:q] == width))
                    if len(rows) < 2:
                        continue
                    part = t.slice(p, q - p).take(pa.array(rows - p))
                    signs = np.frombuffer(b"".join(part.column("signs").to_pylist()), np.uint8).reshape(len(rows), tables, -1)
                    pairs, links = [], np.zeros(len(rows), np.int64)
                    for u, v in _linked(unit_rows(part.column("embedding")), signs, ball[rows], side[rows], at, least):
                        pairs.append((u, v))
                        np.add.at(links, u, copies[rows[v]])
                        np.add.at(links, v, copies[rows[u]])
                    some = np.flatnonzero(links)
                    if len(some):
                        label = _star(pairs, len(rows))
                        for column, values in zip(out, (rep[rows[some]], rep[rows[label[some]]], links[some]), strict=True):
                            column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["a", "b", "links"])

    return of


def _balls(members: DataFrame, least: float) -> DataFrame:
    """(rep, ball): of the hubs that hot keys' members tried, of which HUBS a key, and that a vector is near to, the one that most vectors are near to."""
    hub = F.struct("rep", "embedding")
    picked = members.groupBy("key").agg(F.array(*[F.min_by(hub, F.struct(F.xxhash64("rep", F.lit(i)), "rep")) for i in range(HUBS)]).alias("hubs"))
    picked = cut(picked, "hubs")
    near = cut(members.join(picked, "key").select("rep", "size", "embedding", "hubs").mapInArrow(_to_hubs(least), "rep long, hub long").distinct(), "near-hubs")
    most = near.groupBy("hub").agg(F.count("*").alias("n"))
    out = cut(near.join(most, "hub").groupBy("rep").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("ball")), "balls")
    drop(picked, near)
    return out


def _in_blocks(df: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks in which it meets others, with run: the pair, and side: its own block of it. Blocks of strays meet themselves, each other and those of the main ball, which don't meet each other."""
    s, n = F.col("stray_blocks"), F.col("near_blocks")
    df = df.withColumn("own", F.pmod(F.xxhash64("rep"), F.greatest(F.when(F.col("near"), n).otherwise(s), F.lit(1).cast("long"))))

    def met(run, side):
        return F.struct(run.alias("run"), side.cast("int").alias("side"))

    def among(i):
        side = F.when(F.col("own") == i, ALONE).when(F.col("own") < i, LEFT).otherwise(RIGHT)
        return met(F.xxhash64("key", F.lit("strays"), F.least("own", i), F.greatest("own", i)), side)

    strays = F.concat(_upto(s, among), _upto(n, lambda i: met(F.xxhash64("key", F.lit("ball"), "own", i), F.lit(LEFT))))
    near = _upto(s, lambda i: met(F.xxhash64("key", F.lit("ball"), i, "own"), F.lit(RIGHT)))
    return df.withColumn("met", F.explode(F.when(F.col("near"), near).otherwise(strays))).select("*", "met.run", "met.side").drop("own", "met")


def _met_rows(signed: DataFrame, shared: DataFrame, balls: DataFrame) -> DataFrame:
    """Rows of keys that others share, in blocks."""
    members = signed.join(balls, "rep", "left").withColumn("ball", F.coalesce("ball", F.lit(NO_BALL).cast("long"))).join(shared, "key")
    cold = members.where(F.col("m") <= BLOCK).select("*", F.lit(False).alias("near"), F.lit(1).cast("long").alias("stray_blocks"), F.lit(0).cast("long").alias("near_blocks"))
    # of a hot key, the members of its largest ball need not meet each other
    per_ball = signed.join(shared.where(F.col("m") > BLOCK), "key").join(balls, "rep", "left").groupBy("key", F.coalesce("ball", F.lit(NO_BALL).cast("long")).alias("ball")).agg(F.count("*").alias("n"))
    most = per_ball.groupBy("key").agg(F.sum("n").alias("all"), F.max_by(F.struct("ball", "n"), F.struct(F.col("ball") != NO_BALL, "n", "ball")).alias("most"))
    in_main = F.when(F.col("most.ball") != NO_BALL, F.col("most.n")).otherwise(0)
    main = most.select("key", F.col("most.ball").alias("main"), F.ceil((F.col("all") - in_main) / BLOCK).alias("stray_blocks"), F.ceil(in_main / BLOCK).alias("near_blocks"))
    main = cut(main, "main-balls")
    hot = members.where(F.col("m") > BLOCK).join(main, "key").withColumn("near", (F.col("ball") == F.col("main")) & (F.col("ball") != NO_BALL)).drop("main")
    return _in_blocks(cold.unionByName(hot)).select("run", "side", "rep", "copies", "size", "ball", "table", "embedding", "signs")


def cosine_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding; further columns are ignored).

    Rows are linked if their cosine is least (above 0) or more; n_links counts the other rows linked with a row, component_id is the smallest vec_id among the rows reachable. Vectors that are null, empty, zero
    or hold a null or a component that is not finite are linked with nothing, nor are vectors of different lengths. A row with a null vec_id takes no part: no links, component_id is null and it
    is kept. Equal vectors are linked; rows of one vec_id are rows of their own. Every link counted is confirmed; one at the threshold is missed with probability MISSED, one above it with less.
    A hot key's vectors outside its largest ball meet all others of the key in blocks: work and rows sent grow with the number of such vectors times that of the key's. Runs jobs.
    """
    fine = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    digest = F.when(F.col("vec_id").isNotNull() & fine, F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(12), "embedding").alias("b")))
    rows = vectors.select("vec_id", "embedding", digest.alias("digest"))
    # one row for all with the same vector, under a number of its own, as vec_ids may repeat
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("rep"), F.size("embedding").alias("size"), "*"), "classes")
    tables, planes = tables_for(classes.count(), least)
    kind = classes.schema["embedding"].dataType.simpleString()
    signed = cut(classes.select("rep", "copies", "size", "embedding").mapInArrow(_keys(tables, planes), f"rep long, copies long, size int, embedding {kind}, keys array<long>, signs binary"), "signs")
    signed_by_key = signed.select("rep", "copies", "size", "embedding", "signs", F.posexplode("keys").alias("table", "bits")).withColumn("key", F.xxhash64("size", "table", "bits")).drop("bits")
    shared = cut(signed_by_key.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared-keys")
    hot = cut(signed_by_key.join(shared.where(F.col("m") > BLOCK), "key").select("key", "rep", "size", "embedding"), "hot-members")
    balls = _balls(hot, least)
    links = cut(_whole_runs_of(_met_rows(signed_by_key, shared, balls)).mapInArrow(_met(least, tables), "a long, b long, links long"), "links")
    found = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    in_ball = balls.join(classes.select("rep", "copies"), "rep").groupBy("ball").agg(F.sum("copies").alias("in_ball"))
    in_ball = cut(in_ball, "in-balls")
    to_hub = balls.select(F.col("rep").alias("a"), F.col("ball").alias("b"))
    linked = cut(components(links.select("a", "b").unionByName(to_hub)).withColumnRenamed("node", "rep").join(classes.select("rep", "first_id"), "rep"), "linked")
    roots = cut(linked.groupBy("component").agg(F.min("first_id").alias("root")), "roots")
    named = linked.join(roots, "component").join(balls, "rep", "left").join(in_ball, "ball", "left").join(found, "rep", "left").select("rep", "root", "in_ball", "links")
    named = classes.select("rep", "digest", "first_id", "copies").join(named, "rep", "left")
    n_links = F.coalesce("in_ball", "copies") - 1 + F.coalesce("links", F.lit(0).cast("long"))
    named = cut(named.select("digest", F.coalesce("root", "first_id").alias("root"), n_links.alias("n_links")), "named")
    drop(classes, signed, shared, hot, balls, links, in_ball, linked, roots)
    out = rows.select("vec_id", "digest").join(named, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
