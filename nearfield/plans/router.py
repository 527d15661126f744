"""Per-query plans: correlation of query and filter, thresholds, routes, and execution by route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.scalars import bin_index, class_of, tau
from nearfield.operators import search
from nearfield.operators.search import SearchOptions, small
from nearfield.tables import written

EPS = 1e-9


def correlation(queries: DataFrame, centres: DataFrame, divergence: DataFrame, bins: DataFrame) -> DataFrame:
    """queries (query_id, qvec, lo, hi) with cluster_id, js, p_c, p_g, lift, heuristic, tanh and pgap."""
    near = search.nearest_centroid(queries.select("query_id", F.col("qvec").alias("vec")), centres, key="query_id").select("query_id", "cluster_id")
    q = queries.join(near, "query_id").join(small(divergence), "cluster_id").crossJoin(F.broadcast(bins.select("low", "high", "bins")))
    at = lambda v: bin_index(F.col(v), F.col("low"), F.col("high"), F.col("bins"))

    def mass(cdf: str) -> Column:
        below = F.when(at("lo") > 0, F.element_at(cdf, F.greatest(at("lo"), F.lit(1)))).otherwise(F.lit(0.0))
        return F.element_at(cdf, at("hi") + 1) - below

    q = q.withColumn("p_c", mass("cdf")).withColumn("p_g", mass("gcdf"))
    q = q.withColumn("lift", F.ln((F.col("p_c") + EPS) / (F.col("p_g") + EPS)))
    return q.select(
        *queries.columns, "cluster_id", "js", "p_c", "p_g", "lift", (F.col("js") * F.signum("lift")).alias("heuristic"), (F.col("js") * F.tanh("lift")).alias("tanh"), (F.col("js") * (F.col("p_c") - F.col("p_g"))).alias("pgap")
    )


def two_route(planned: DataFrame, negative_limit: float = 0.30) -> DataFrame:
    """planned (selectivity, heuristic) with plan PRE or ACORN: by selectivity, or by a negative correlation at a low enough one."""
    sel = F.col("selectivity")
    pre = (sel <= tau(sel, "true")) | ((sel <= negative_limit) & (F.col("heuristic") <= -tau(sel, "heuristic")))
    return planned.withColumn("tau", tau(sel, "heuristic")).withColumn("plan", F.when(pre, F.lit("PRE")).otherwise(F.lit("ACORN")))


def three_route(planned: DataFrame, pre_limit: float = 0.05) -> DataFrame:
    """planned with plan PRE, ACORN or POST and the correlation's class, whose limits belong to the outer classes here."""
    t, c = tau(F.col("selectivity"), "heuristic"), F.col("heuristic")
    plan = F.when(F.col("selectivity") < pre_limit, F.lit("PRE")).when(c <= -t, F.lit("ACORN")).otherwise(F.lit("POST"))
    kind = F.when(c <= -t, F.lit("negative")).when(c >= t, F.lit("positive")).otherwise(F.lit("random"))
    return planned.withColumn("tau", t).withColumn("plan", plan).withColumn("correlation_type", kind)


def classified(scores: DataFrame, metric: str, threshold: float) -> DataFrame:
    """scores with predicted: the class of a metric at a threshold."""
    return scores.withColumn("predicted", class_of(F.col(metric), F.lit(threshold)))


def routed(base: DataFrame, planned: DataFrame, cells: DataFrame, options: SearchOptions, n_probe: int) -> DataFrame:
    """(query_id, rank, vec_id, d2, plan): each query answered by its plan's strategy. The planned queries and the cells are written once, and the routes are branches of one plan over them."""
    planned, cells = written(planned.select("query_id", "qvec", "lo", "hi", "plan"), "planned"), written(cells, "cells")
    of = lambda p: planned.where(F.col("plan") == p).select("query_id", "qvec", "lo", "hi")
    cols = ["query_id", "rank", "vec_id", "d2"]
    pre = search.pre_filter(base, of("PRE"), options.k).select(*cols, F.lit("PRE").alias("plan"))
    post = search.post_filter(base, of("POST"), options).select(*cols, F.lit("POST").alias("plan"))
    acorn = search.probe(base, of("ACORN"), cells, options.k, n_probe).select(*cols, F.lit("ACORN").alias("plan"))
    return pre.unionByName(post).unionByName(acorn)


def weighted(per_strategy: DataFrame) -> DataFrame:
    """One row (n, recall): mean recall by numbers of queries; per_strategy: n, recall."""
    return per_strategy.agg(F.sum("n").alias("n"), (F.sum(F.col("recall") * F.col("n")) / F.sum("n")).alias("recall"))
