"""Workloads: ranges of a wanted selectivity around, away from and regardless of a query, and mixed sets. No engine's random numbers: hashes by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.quantiles import quantiles
from nearfield.operators.ranks import counted_up_to, latest, running
from nearfield.operators.search import knn, small
from nearfield.tables import written

#: Multiplier and modulus of the hash.
MUL, MOD = 73244475, 2147483648


def draw(x: Column, salt: int = 0) -> Column:
    """A pseudorandom integer below 2**31 from an integer: shifts and products that mix upper bits into lower ones, so remainders by any number are spread alike."""
    h = F.pmod(x + salt * 7919, F.lit(MOD))
    for shift in (16, 15):
        h = (h.bitwiseXOR(F.shiftright(h, shift)) * MUL) % MOD
    return h.bitwiseXOR(F.shiftright(h, 16))


def positions(base: DataFrame, attr: str = "attr") -> DataFrame:
    """(v, first, last): where each value of a numeric attribute stands in its order, from 0; a row per value, so the sort is of counts."""
    counts = base.groupBy(F.col(attr).alias("v")).agg(F.count("*").alias("n"))
    return running(counts, "v", "upto", of="n").withColumn("last", F.col("upto") - 1).withColumn("first", F.col("last") - F.col("n") + 1).select("v", "first", "last")


def values_at(queries: DataFrame, pos: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """queries with, for each column at of wanted, its name: the sorted attribute's value at that position; beyond the last position there is none, and no row. Runs a job."""
    out = latest(queries, pos.select("v", "first", "last"), {at: f"_row_{name}" for at, name in wanted.items()}, "first")
    for at, name in wanted.items():
        out = out.where(F.col(at) <= F.col(f"_row_{name}.last")).withColumn(name, F.col(f"_row_{name}.v")).drop(f"_row_{name}")
    return out


def value_at(queries: DataFrame, pos: DataFrame, at: str, name: str) -> DataFrame:
    """values_at() for one column."""
    return values_at(queries, pos, {at: name})


def random_ranges(base: DataFrame, queries: DataFrame, share: float, salt: int = 0) -> DataFrame:
    """(query_id, lo, hi): the values at a pseudorandom start and a target's number of positions on."""
    n = base.agg(F.count("*").alias("n"))
    q = queries.select("query_id").crossJoin(F.broadcast(n))
    q = q.withColumn("t", F.greatest(F.lit(1), F.least(F.col("n"), F.floor(share * F.col("n")))))
    q = q.withColumn("start", draw(F.col("query_id"), salt) % (F.col("n") - F.col("t") + 1)).withColumn("end", F.least(F.col("n") - 1, F.col("start") + F.col("t")))
    pos = positions(base)
    return values_at(q, pos, {"start": "lo", "end": "hi"}).select("query_id", "lo", "hi")


def correlated_ranges(base: DataFrame, queries: DataFrame, share: float, k: int) -> DataFrame:
    """(query_id, centre, pos_lo, pos_hi, neg_lo, neg_hi): ranges around the median attribute of the k nearest, and in the tail away from it."""
    near = knn(base, queries, k).join(base.select("vec_id", "attr"), "vec_id")
    centre = near.groupBy("query_id").agg(F.percentile("attr", 0.5).alias("centre"))
    whole = base.agg(F.count("*").alias("n")).join(F.broadcast(quantiles(base, "attr", [0.5]).select(F.col("q")[0].alias("median"))), how="left")  # one row, or none
    q = centre.crossJoin(F.broadcast(whole)).withColumn("t", F.greatest(F.lit(1), F.least(F.col("n"), F.floor(share * F.col("n")))))
    pos = positions(base)
    counts = base.groupBy(F.col("attr").alias("v")).agg(F.count("*").alias("n"))
    q = counted_up_to(q, counts, "centre", "at", False).withColumn("half", F.floor(F.col("t") / 2))
    q = q.withColumn("a", F.greatest(F.lit(0), F.col("at") - F.col("half"))).withColumn("b", F.least(F.col("n") - 1, F.col("at") + F.col("half")))
    left = F.col("centre") > F.col("median")
    q = q.withColumn("c", F.when(left, F.lit(0)).otherwise(F.col("n") - F.col("t"))).withColumn("d", F.when(left, F.col("t") - 1).otherwise(F.col("n") - 1))
    q = values_at(q, pos, {"a": "pos_lo", "b": "pos_hi", "c": "neg_lo", "d": "neg_hi"})
    return q.select("query_id", "centre", "pos_lo", "pos_hi", "neg_lo", "neg_hi")


def rejection_ranges(base: DataFrame, queries: DataFrame, share: float, tries: int = 64, tolerance: float = 0.05) -> DataFrame:
    """(query_id, try, lo, hi, actual): the first of up to 64 drawn ranges whose selectivity is near enough, else the earliest of the nearest."""
    n = base.agg(F.count("*").alias("n"))
    q = queries.select("query_id").crossJoin(F.broadcast(n)).withColumn("t", F.greatest(F.lit(1), F.least(F.col("n"), F.floor(share * F.col("n")))))
    q = q.withColumn("try", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tries - 1).cast("long"))))
    q = q.withColumn("start", draw(F.col("query_id") * 64 + F.col("try"), 3) % (F.col("n") - F.col("t") + 1)).withColumn("end", F.col("start") + F.col("t") - 1)
    pos = written(positions(base), "positions")
    q = values_at(q, pos, {"start": "lo", "end": "hi"})
    q = q.join(pos.select(F.col("v").alias("lo"), F.col("first").alias("lo_first")), "lo").join(pos.select(F.col("v").alias("hi"), F.col("last").alias("hi_last")), "hi")
    q = q.withColumn("actual", (F.col("hi_last") - F.col("lo_first") + 1) / F.col("n")).withColumn("error", F.abs(F.col("actual") - share))
    good = F.col("error") <= F.greatest(1 / F.col("n"), F.lit(tolerance * share))
    best = F.coalesce(F.min(F.when(good, F.struct(F.lit(0.0).alias("e"), "try", "lo", "hi", "actual"))), F.min(F.struct(F.col("error").alias("e"), "try", "lo", "hi", "actual")))
    return q.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.try", "b.lo", "b.hi", "b.actual")


def uniform_selectivities(queries: DataFrame, low: float = 1e-4, high: float = 0.4, salt: int = 10) -> DataFrame:
    """queries with target_selectivity: pseudorandom, uniform between low and high."""
    return queries.withColumn("target_selectivity", low + (high - low) * draw(F.col("query_id"), salt) / MOD)


def drawn_queries(pool: DataFrame, n: int, salt: int = 11) -> DataFrame:
    """(query_id, source_id, qvec): n queries of pool (query_id, qvec) by hash, numbered anew from 0; with replacement where the pool has fewer."""
    named = pool.select(F.col("query_id").alias("source_id"), "qvec")
    if pool.count() < n:
        picked = sample_with_replacement(pool, n, salt).select(F.col("draw").alias("query_id"), F.col("query_id").alias("source_id"))
    else:
        first = pool.select("query_id", draw(F.col("query_id"), salt).alias("u")).orderBy("u", "query_id").limit(n)
        picked = running(first, "u", "r", ("query_id",)).select((F.col("r") - 1).alias("query_id"), F.col("query_id").alias("source_id"))
    return picked.join(named, "source_id").select("query_id", "source_id", "qvec")


def category_ranges(rows: DataFrame, category: str, queries: DataFrame, share: float) -> DataFrame:
    """(query_id, lo, hi): a code with a share near the wanted one, drawn per query; codes are dense in order of the categories' names."""
    counts = rows.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("c"))
    everything = Window.orderBy(category)
    coded = counts.withColumn("code", F.dense_rank().over(everything).cast("long") - 1).withColumn("n", F.sum("c").over(Window.partitionBy()))
    coded = coded.withColumn("gap", F.abs(F.col("c") / F.col("n") - share)).withColumn("near", F.col("gap") <= F.greatest(1 / F.col("n"), F.lit(0.35 * share)))
    coded = coded.withColumn("some", F.max("near").over(Window.partitionBy())).withColumn("values", F.count("*").over(Window.partitionBy()))
    most = F.when(F.col("some"), F.lit(64)).otherwise(F.least(F.col("values"), F.greatest(F.lit(8), F.least(F.lit(64), F.ceil(F.sqrt("values"))))))
    ranked = coded.where(F.col("near") | ~F.col("some")).withColumn("r", F.row_number().over(Window.orderBy("gap", "code"))).where(F.col("r") <= most)
    pool = ranked.withColumn("pool", F.count("*").over(Window.partitionBy())).select(F.col("r").alias("pick"), "pool", "code")
    size = pool.select("pool").limit(1)
    q = queries.select("query_id").crossJoin(F.broadcast(size)).withColumn("pick", draw(F.col("query_id"), 5) % F.col("pool") + 1)
    return q.join(small(pool.drop("pool")), "pick").select("query_id", F.col("code").alias("lo"), F.col("code").alias("hi"))


def split_evenly(n: int, parts: int) -> list[int]:
    """n over parts, the rest to the first."""
    return [n // parts + (i < n % parts) for i in range(parts)]


def mixed_set(queries: DataFrame, n: int, salt: int = 1) -> DataFrame:
    """(query_id, label, backend): disjoint classes of positive, negative and random queries in a pseudorandom order."""
    pos, neg, _ = split_evenly(n, 3)
    r = running(queries.select("query_id", draw(F.col("query_id"), salt).alias("u")), "u", "r", ("query_id",)).where(F.col("r") <= n)
    label = F.when(F.col("r") <= pos, F.lit("positive")).when(F.col("r") <= pos + neg, F.lit("negative")).otherwise(F.lit("random"))
    return r.select("query_id", label.alias("label")).withColumn("backend", F.when(F.col("label") == "random", F.lit("rand")).otherwise(F.lit("corr")))


def held_out(rows: DataFrame, share: float, key: str = "vec_id", salt: int = 2) -> DataFrame:
    """rows with part: 'query' for about that share of keys by hash, else 'base'."""
    return rows.withColumn("part", F.when(draw(F.col(key), salt) % 1000 < int(share * 1000), F.lit("query")).otherwise(F.lit("base")))


def sample_with_replacement(pool: DataFrame, n: int, salt: int = 4) -> DataFrame:
    """(draw, query_id): n draws from a pool of fewer."""
    ranked = running(pool.select("query_id"), "query_id", "place").select("query_id", (F.col("place") - 1).alias("at"))
    size = pool.agg(F.count("*").alias("size"))
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw")).crossJoin(F.broadcast(size)).withColumn("at", draw(F.col("draw"), salt) % F.col("size"))
    return draws.join(small(ranked), "at").select("draw", "query_id")
