"""Nearest-neighbour search under a range predicate: exact, over-fetched, and by probed cells."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.vectors import squared_l2
from nearfield.operators import blocks
from nearfield.operators.intervals import range_join
from nearfield.operators.ranks import counted
from nearfield.tables import written

#: Bytes up to which a side that is expected to be small is broadcast; beyond, the join is a shuffle.
BROADCAST_BYTES = 32 << 20
#: Parts of the rows that each block of queries meets, where queries are not broadcast; queries of one range that go to its rows together.
PARTS, RANGE_QUERIES = 64, 256


@dataclass(frozen=True)
class SearchOptions:
    """k, and the over-fetch ladder's settings; complete: queries for which the ladder ends too early are answered by the exact search."""

    k: int = 10
    fetch_mult: float = 2.0
    min_valid_mult: float = 2.0
    max_fetch_k: int = 4096
    max_retries: int = 5
    complete: bool = True

    def __post_init__(self):
        if self.k < 1 or self.max_fetch_k < 1 or self.max_retries < 0:
            raise ValueError("k and max_fetch_k must be positive, max_retries not negative")
        if not (self.fetch_mult > 0 and self.min_valid_mult > 0):
            raise ValueError("multipliers must be positive")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: eight a number, and what strings and arrays hold."""
    def of(c: Column, kind) -> Column:
        if isinstance(kind, T.ArrayType):
            each = F.lit(8) if not isinstance(kind.elementType, (T.ArrayType, T.StringType, T.StructType)) else F.lit(64)
            return F.coalesce(F.size(c), F.lit(0)) * each + 16
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16 if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(8)

    return reduce(Column.__add__, [of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16))


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_BYTES, as it is otherwise. Runs a job over df, so df should be cheap to compute twice."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else df


def bytes_of(df: DataFrame) -> int:
    """How many bytes df takes, about."""
    return df.agg(F.coalesce(F.sum(row_bytes(df).cast("long")), F.lit(0).cast("long"))).first()[0]


def top_k(pairs: DataFrame, k: int, by: Column | str = "d2", of: str = "query_id", tie: str = "vec_id") -> DataFrame:
    """The k first rows of each query by distance and id, with rank from 1; Spark limits groups before and after the shuffle."""
    order = [F.col(by) if isinstance(by, str) else by, tie]
    rank = F.row_number().over(Window.partitionBy(of).orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def in_range(base: DataFrame, queries: DataFrame, k: int, attr: str = "attr") -> DataFrame:
    """(query_id, vec_id, d2): rows in the queries' ranges, the k nearest of each query among them; which of the others are there is open. A query meets the parts of rows that its range touches."""
    if not blocks.numeric((base, attr), (queries, "lo"), (queries, "hi")):
        return range_join(base, queries, attr).select("query_id", "vec_id", squared_l2("vec", "qvec").alias("d2"))
    dealt = blocks.by_range(base.select("vec_id", "vec", attr), queries.select("query_id", "qvec", "lo", "hi"), attr)
    return blocks.nearest(*dealt, k, attr=attr).withColumnRenamed("score", "d2")


def pre_filter(base: DataFrame, queries: DataFrame, k: int, attr: str = "attr") -> DataFrame:
    """Exact search: filter by range, then distances, then the k nearest. An empty range gives no rows.

    base: vec_id, vec, attr; queries: query_id, qvec, lo, hi. Runs jobs, which count both.
    """
    return top_k(in_range(base, queries, k, attr), k)


def ground_truth(base: DataFrame, queries: DataFrame, k: int, attr: str = "attr") -> DataFrame:
    """Exact filtered neighbours with each different range looked up once: its parts of the rows are found for the range, and its queries go to these, up to RANGE_QUERIES of them together. Runs jobs."""
    if not blocks.numeric((base, attr), (queries, "lo"), (queries, "hi")):
        return pre_filter(base, queries, k, attr)
    ranges = queries.groupBy("lo", "hi").agg(F.ceil(F.count("*") / RANGE_QUERIES).cast("int").alias("_cuts"))
    cuts = ranges.withColumn("_cut", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).withColumn("query_id", F.xxhash64("lo", "hi", "_cut"))
    rows, places = blocks.by_range(base.select("vec_id", "vec", attr), cuts, attr, queries)
    cut = queries.join(ranges, ["lo", "hi"]).withColumn("_cut", F.pmod(F.xxhash64("query_id"), F.col("_cuts")).cast("int"))
    asked = cut.join(places.select("lo", "hi", "_cut", "_part", "_block"), ["lo", "hi", "_cut"])
    return top_k(blocks.nearest(rows, asked, k, attr=attr).withColumnRenamed("score", "d2"), k)


def all_pairs(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query against every row: what an unfiltered exact search scores. Queries go to the rows in one broadcast block where they are small.

    Where they are not, queries are cut into blocks of about BROADCAST_BYTES and rows into PARTS parts, and each block meets each part.
    """
    size = bytes_of(queries)
    if size <= BROADCAST_BYTES:
        return base.crossJoin(F.broadcast(queries))
    blocks = -(-size // BROADCAST_BYTES)
    rows = base.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asked = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return rows.join(asked, ["_block", "_part"]).drop("_block", "_part")


def knn(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact unfiltered neighbours by distance. Runs jobs, which count both."""
    dealt = blocks.by_hash(base.select("vec_id", "vec"), queries.select("query_id", "qvec"))
    return top_k(blocks.nearest(*dealt, k).withColumnRenamed("score", "d2"), k)


def knn_self_by_inner(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Neighbours by inner product among the rows themselves, the row left out by its id. Runs jobs, which count both."""
    dealt = blocks.by_hash(base.select("vec_id", "vec"), queries.select("query_id", "qvec"))
    return top_k(blocks.nearest(*dealt, k, inner=True, others=True).withColumnRenamed("score", "ip"), k, by=F.col("ip").desc())


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, cluster_id, d2) of the nearest centroid, ties to the smaller cluster; centroids: cluster_id, centroid."""
    pairs = vectors.crossJoin(small(centroids)).select(key, "cluster_id", squared_l2("vec", "centroid").alias("d2"))
    best = pairs.groupBy(key).agg(F.min(F.struct("d2", "cluster_id")).alias("b"))
    return best.select(key, "b.cluster_id", "b.d2")


def centroids(vectors: DataFrame, label: str = "cluster_id", clusters: DataFrame | None = None) -> DataFrame:
    """(cluster_id, centroid): means of the members' components. clusters (cluster_id): those to return, zeros for one without members; by default those that have some."""
    each = vectors.select(F.col(label).alias("cluster_id"), F.posexplode("vec").alias("pos", "x"))
    mean = each.groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    out = mean.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c")).select("cluster_id", F.transform("c", lambda p: p["x"]).alias("centroid"))
    if clusters is None:
        return out
    width = out.agg(F.coalesce(F.max(F.size("centroid")), F.lit(0)).alias("width"))
    zeros = F.array_repeat(F.lit(0.0), F.col("width"))
    return clusters.select("cluster_id").distinct().join(out, "cluster_id", "left").crossJoin(F.broadcast(width)).select("cluster_id", F.coalesce("centroid", zeros).alias("centroid"))


def first_queries(queries: DataFrame, n: int) -> DataFrame:
    """The queries with ids from 0 to n - 1: a shorter run of the same workload."""
    return queries.where(F.col("query_id").between(0, n - 1))


def post_filter(base: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(), attr: str = "attr", ranked: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Over-fetch and filter: rank rows by distance, fetch a number that the selectivity suggests, and double it until enough of them are in range.

    The ladder is settled in one pass: of the rows in range the first ones decide at which rung it stops, so their overall ranks are counted, each rung's fetch size follows from the counts, and the first rung
    that suffices is taken. Where the last rung has fewer than min(k, rows in range), options.complete answers the query exactly. Rows in range beyond the k-th are counted
    twice, as the rule does; strict counts them once. ranked: query_id, vec_id, d2, attr of candidates, by default all rows. Adds fetched and retries of the query. Runs jobs.
    """
    o = options
    asked = queries.select("query_id", "lo", "hi")
    # a rung is sure to suffice with a target's number of rows in range beyond the k-th
    enough = o.k + max(o.k, math.ceil(o.k * o.min_valid_mult))
    if ranked is None:
        sizes = base.agg(F.count("*").alias("n"))
        values = base.groupBy(F.col(attr).alias("v")).agg(F.count("*").alias("n"))
        held = counted(asked.where("lo <= hi"), values, {"hi": ("upto", True), "lo": ("below", False)}).select("query_id", (F.col("upto") - F.col("below")).alias("m"))
        held = held.where("m > 0").crossJoin(F.broadcast(sizes))
        hits = ranks_overall(base, queries, top_k(in_range(base, queries, enough, attr), enough).drop("rank"))
    else:
        sizes = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
        inside = ranked.join(asked, "query_id").where("attr between lo and hi")
        held = inside.groupBy("query_id").agg(F.count("*").alias("m")).join(sizes, "query_id")
        first = top_k(ranked, o.max_fetch_k).select("query_id", "vec_id", F.col("rank").alias("pos"))
        hits = inside.select("query_id", "vec_id", "d2").join(first, ["query_id", "vec_id"], "left")
    places = hits.where(F.col("pos") <= o.max_fetch_k).groupBy("query_id").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    per = held.join(places, "query_id", "left").withColumn("at", F.coalesce("at", F.array().cast("array<bigint>")))
    k = o.k
    cap = F.least(F.lit(o.max_fetch_k), F.col("n"))
    first = F.ceil(k / F.greatest(F.col("m") / F.col("n"), F.lit(1e-6)) * o.fetch_mult)
    per = per.withColumn("cap", cap.cast("long"))
    per = per.withColumn("f0", F.least(F.greatest(F.lit(k), F.least(first, F.lit(o.max_fetch_k))), F.col("n")).cast("long"))
    per = per.withColumn("t", F.greatest(F.lit(k), F.least(F.col("m"), F.ceil(F.lit(k * o.min_valid_mult)))).cast("long"))
    in_first = lambda x: F.size(F.filter("at", lambda p: p <= x))

    def rung(i: Column) -> Column:
        fetch = F.least(F.col("cap"), F.col("f0") * F.pow(F.lit(2), i).cast("long"))
        fetch = F.when(i == 0, F.col("f0")).otherwise(fetch)
        valid = in_first(fetch)
        found = F.least(F.lit(k), valid)
        beyond = valid - (in_first(F.least(F.lit(k), fetch)) if not strict else found)
        seen = F.least(F.col("t"), found + beyond)
        done = ((found >= k) & (seen >= F.col("t"))) | (i >= o.max_retries) | (fetch >= F.col("cap"))
        return F.struct(done.alias("done"), fetch.alias("fetched"), i.cast("long").alias("retries"), (valid < F.least(F.lit(k), F.col("m"))).alias("short"))

    rungs = F.transform(F.sequence(F.lit(0), F.lit(o.max_retries)), rung)
    per = per.withColumn("stop", F.element_at(F.filter(rungs, lambda r: r["done"]), 1))
    per = per.select("query_id", "stop.fetched", "stop.retries", "stop.short")
    fits = F.col("pos") <= F.least(F.col("fetched"), F.lit(o.max_fetch_k))
    kept = hits.join(per, "query_id").where(F.coalesce(fits, F.lit(False)) | F.col("short") if o.complete else fits)
    return top_k(kept.select("query_id", "vec_id", "d2", "fetched", "retries"), k).select("query_id", "rank", "vec_id", "d2", "fetched", "retries")


def ranks_overall(base: DataFrame, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (query_id, vec_id, d2), a bounded number a query, with pos: the rank that each has among all rows of base by distance and id. Rows before a hit are counted part by part. Runs jobs."""
    lists = written(hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("d2", "vec_id"))).alias("at")), "hits")
    counts = blocks.nearer(*blocks.by_hash(base.select("vec_id", "vec"), queries.select("query_id", "qvec").join(lists, "query_id")))
    before = counts.select("query_id", F.posexplode("counts").alias("i", "c")).groupBy("query_id", "i").agg((F.sum("c") + 1).alias("pos"))
    each = lists.select("query_id", F.posexplode("at").alias("i", "hit")).join(before, ["query_id", "i"])
    return each.select("query_id", "hit.vec_id", "hit.d2", "pos")


def probe(base: DataFrame, queries: DataFrame, cells: DataFrame, k: int, n_probe: int, attr: str = "attr") -> DataFrame:
    """Approximate search: the cells whose centroids are nearest among those that hold rows in range, with the predicate applied inside them.

    n_probe such cells are probed, and more until they hold k rows in range, so a query gets k rows where there are as many. Which cells hold how many comes from counts of
    values per cell. base: vec_id, vec, attr, cluster_id; cells: cluster_id, centroid. An equi-join on the cell; with all cells probed it is the exact search.
    """
    counts = base.groupBy("cluster_id", F.col(attr).alias("attr")).agg(F.count("*").alias("c"))
    held = range_join(counts, queries.select("query_id", "lo", "hi")).groupBy("query_id", "cluster_id").agg(F.sum("c").alias("m"))
    near = held.join(queries, "query_id").join(small(cells), "cluster_id").withColumn("c2", squared_l2("qvec", "centroid"))
    order = Window.partitionBy("query_id").orderBy("c2", "cluster_id")
    near = near.withColumn("r", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = near.where((F.col("r") <= n_probe) | (F.col("before") < k)).select("query_id", "qvec", "lo", "hi", "cluster_id")
    if blocks.numeric((base, attr), (queries, "lo"), (queries, "hi")):
        dealt = blocks.by_cell(base.select("vec_id", "vec", attr, "cluster_id"), written(near, "probed"), "cluster_id")
        return top_k(blocks.nearest(*dealt, k, attr=attr).withColumnRenamed("score", "d2"), k)
    pairs = base.join(near, "cluster_id").where(F.col(attr).between(F.col("lo"), F.col("hi")))
    return top_k(pairs.select("query_id", "vec_id", squared_l2("vec", "qvec").alias("d2")), k)


def filter_topk(candidates: DataFrame, attrs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The first k candidates in range, in the candidates' own order; candidates: query_id, pos, vec_id, d2; unknown vec_ids are passed over."""
    both = candidates.join(attrs, "vec_id").join(small(queries.select("query_id", "lo", "hi")), "query_id").where("attr between lo and hi")
    return top_k(both, k, by="pos").select("query_id", "rank", "vec_id", "d2")


def recall(results: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, recall): share of the true neighbours found; without any, 1 if nothing was returned and else 0."""
    hit = truth.select("query_id", "vec_id").join(results.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    true, got = truth.groupBy("query_id").agg(F.count("*").alias("true")), results.groupBy("query_id").agg(F.count("*").alias("got"))
    all_ = queries.select("query_id").join(true, "query_id", "left").join(got, "query_id", "left").join(hit, "query_id", "left").na.fill(0)
    empty = F.when(F.col("got") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return all_.select("query_id", F.when(F.col("true") == 0, empty).otherwise(F.col("hits") / F.col("true")).alias("recall"))


def interval_overlap(base: DataFrame, queries: DataFrame, k: int, attr: str = "attr") -> DataFrame:
    """(query_id, overlap): share of the unfiltered k nearest that lie in the query's range."""
    near = knn(base, queries, k).join(base.select("vec_id", F.col(attr).alias("attr")), "vec_id").join(small(queries.select("query_id", "lo", "hi")), "query_id")
    return near.groupBy("query_id").agg(F.avg(F.col("attr").between(F.col("lo"), F.col("hi")).cast("double")).alias("overlap"))


def neighbour_stats(base: DataFrame, queries: DataFrame, attrs: DataFrame, k: int) -> DataFrame:
    """(query_id, neighbour_mean, mean_abs_diff): attribute of the k nearest rows against the query's own; queries: query_id, qvec, own."""
    near = knn(base, queries, k).join(attrs, "vec_id").join(small(queries.select("query_id", "own")), "query_id")
    return near.groupBy("query_id").agg(F.avg("attr").alias("neighbour_mean"), F.avg(F.abs(F.col("attr") - F.col("own"))).alias("mean_abs_diff"))
