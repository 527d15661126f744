"""End-to-end evaluation of the strategies over a workload."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import search, stats
from nearfield.operators.search import SearchOptions
from nearfield.plans import router


def strategies(base: DataFrame, cells: DataFrame, options: SearchOptions, n_probe: int) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Functions from queries (query_id, qvec, lo, hi) to (query_id, rank, vec_id, d2)."""
    cols = ("query_id", "rank", "vec_id", "d2")
    return {
        "PRE": lambda q: search.pre_filter(base, q, options.k).select(*cols),
        "POST": lambda q: search.post_filter(base, q, options).select(*cols),
        "ACORN": lambda q: search.probe(base, q, cells, options.k, n_probe).select(*cols),
    }


def plan_queries(base: DataFrame, queries: DataFrame, cells: DataFrame, rule: Callable[[DataFrame], DataFrame] = router.three_route) -> DataFrame:
    """queries with cluster, correlation scores, selectivity, threshold and plan, in one lazy DataFrame."""
    bins = stats.choose_bins(base)
    divergence = stats.cluster_divergence(stats.histogram(base, bins, by="cluster_id"), stats.histogram(base, bins))
    scored = router.correlation(queries, cells, divergence, bins).join(stats.selectivity(base, queries).select("query_id", "selectivity"), "query_id")
    return rule(scored)


def evaluate(base: DataFrame, queries: DataFrame, cells: DataFrame, options: SearchOptions = SearchOptions(), n_probe: int = 4, rule: Callable[[DataFrame], DataFrame] = router.three_route) -> DataFrame:
    """(strategy, queries, seconds, qps, recall, planner_pre, planner_post, planner_acorn): each strategy and the planner; the planner's seconds include planning."""
    spark = base.sparkSession
    truth = search.ground_truth(base, queries, options.k).select("query_id", "vec_id").cache()
    n, rows = queries.count(), []
    of = strategies(base, cells, options, n_probe)
    for name in (*of, "PLANNER"):
        began, counts = time.perf_counter(), {}
        if name == "PLANNER":
            planned = plan_queries(base, queries, cells, rule).cache()
            counts = {r["plan"]: r["n"] for r in planned.groupBy("plan").agg(F.count("*").alias("n")).collect()}
            got = router.routed(base, planned, cells, options, n_probe).cache()
        else:
            got = of[name](queries).cache()
        got.count()
        took = time.perf_counter() - began
        recall = search.recall(got, truth, queries).agg(F.avg("recall")).first()[0]
        rows.append((name, n, took, n / max(took, 1e-9), recall, counts.get("PRE", 0), counts.get("POST", 0), counts.get("ACORN", 0)))
        got.unpersist()
    truth.unpersist()
    return spark.createDataFrame(rows, "strategy string, queries long, seconds double, qps double, recall double, planner_pre long, planner_post long, planner_acorn long")
