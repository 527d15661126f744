"""Calibration runs as tables: null scores over selectivities, classes of ranges compared, predictions counted, strategies side by side."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.scalars import class_of, finite, tau
from nearfield.operators import calibrate, search, stats, workload
from nearfield.operators.prefixes import prefix_quantiles
from nearfield.operators.quantiles import quantiles
from nearfield.operators.search import SearchOptions
from nearfield.plans import evaluate, router
from nearfield.plans.states import State
from nearfield.tables import written

METRICS = {"true": "true_correlation", "heuristic": "heuristic_correlation", "tanh": "tanh_correlation", "pgap": "pgap_correlation"}
#: Order of the classes in tables of predictions.
CLASSES = ("negative", "random", "positive")


@dataclass(frozen=True)
class NullRun:
    """A null experiment: scores per query; summary, quantiles and largest scores per selectivity; history of the thresholds."""

    scores: DataFrame
    summary: DataFrame
    quantiles: DataFrame
    largest: DataFrame
    history: DataFrame


def parse_selectivities(raw: str) -> list[float]:
    """The numbers of a list with commas, in order; blanks are passed over, and none, or one outside (0, 1], is an error."""
    out = sorted(float(part) for part in raw.split(",") if part.strip())
    if not out or not all(0 < s <= 1 for s in out):
        raise ValueError(f"selectivities must be numbers in (0, 1]: {raw!r}")
    return out


def scores(state: State, queries: DataFrame, k: int, subsets: int | None = None) -> DataFrame:
    """Scores of queries (query_id, qvec, lo, hi) over a backend: query_id, range_lo, range_hi, subset_size, k_used, the four correlations of METRICS, js_divergence, lift, p_c,
    p_g, expected_random_gk, admissible_gk, expected_random_gk_stderr.

    subsets: how many random subsets the expected distance is taken from; by default it is in closed form and has no error. Empty ranges have no true correlation.
    """
    base, q = state.base, queries.select("query_id", "qvec", "lo", "hi")
    bins = stats.choose_bins(base)
    divergence = stats.cluster_divergence(stats.histogram(base, bins, by="cluster_id"), stats.histogram(base, bins))
    parts = router.correlation(q, state.cells, divergence, bins)
    if subsets is None:
        truth = calibrate.true_correlation(base, q, k).withColumn("stderr", F.lit(None).cast("double"))
    else:
        near = calibrate.admissible(base, q, k)
        truth = near.join(calibrate.drawn_correlation(base, q, k, subsets), "query_id", "left")
    named = {"s": "subset_size", "kk": "k_used", "corr": METRICS["true"], "heuristic": METRICS["heuristic"], "tanh": METRICS["tanh"], "pgap": METRICS["pgap"], "js": "js_divergence", "lift": "lift", "p_c": "p_c", "p_g": "p_g", "e": "expected_random_gk", "g": "admissible_gk", "stderr": "expected_random_gk_stderr"}
    both = parts.join(truth, "query_id")
    return both.select("query_id", F.col("lo").alias("range_lo"), F.col("hi").alias("range_hi"), *[F.col(a).alias(b) for a, b in named.items()])


def null_scores(state: State, queries: DataFrame, selectivity: float, k: int, subsets: int) -> DataFrame:
    """scores() of queries (query_id, qvec) with random ranges near a selectivity: adds actual_selectivity, the absolute correlations and monte_carlo_samples."""
    ranges = workload.rejection_ranges(state.base, queries, selectivity)
    out = scores(state, queries.join(ranges.select("query_id", "lo", "hi"), "query_id"), k, subsets).join(ranges.select("query_id", F.col("actual").alias("actual_selectivity")), "query_id")
    return out.withColumns({f"abs_{c}": F.abs(c) for c in METRICS.values()} | {"monte_carlo_samples": F.lit(subsets)})


def null_history(scored: DataFrame, every: int) -> DataFrame:
    """(selectivity, processed, and the 0.99 quantile of each metric's absolute score so far) at each multiple of every, and at the end; queries are numbered from 0."""
    long = scored.select("selectivity", (F.col("query_id") + 1).alias("at"), *[F.when(finite(F.col(c)), F.abs(c)).alias(m) for m, c in METRICS.items()])
    long = long.unpivot(["selectivity", "at"], list(METRICS), "metric", "v").withColumn("series", F.concat_ws(" ", "metric", F.col("selectivity").cast("string")))
    last = long.groupBy("series", "metric", "selectivity").agg(F.max("at").alias("n"))
    every_ = F.lit(every).cast("long")
    points = F.array_distinct(F.concat(F.when(F.col("n") >= every_, F.sequence(every_, "n", every_)).otherwise(F.array().cast("array<bigint>")), F.array("n")))
    points = last.select("series", "metric", "selectivity", F.explode(points).alias("at"))
    tau = points.join(prefix_quantiles(long.select("series", "at", "v"), points, 0.99), ["series", "at"], "left")
    return tau.groupBy("selectivity", F.col("at").alias("processed")).pivot("metric", list(METRICS)).agg(F.first("tau"))


def null_experiment(state: State, pool: DataFrame, selectivities: list[float], n: int, k: int, subsets: int = 32, every: int = 100, salt: int = 11) -> NullRun:
    """What the scores are where range and query have nothing to do with each other: n queries of pool (query_id, qvec), ranges at random, for each selectivity.

    The thresholds are the 0.99 quantiles of summary (selectivity, queries, actual_mean, actual_least, actual_most, and <metric>_tau_q99). Scores are written once, the tables made of them are lazy.
    """
    queries = workload.drawn_queries(pool, n, salt).select("query_id", "qvec")
    each = [null_scores(state, queries, s, k, subsets).withColumn("selectivity", F.lit(s)) for s in selectivities]
    return null_tables(written(reduce(DataFrame.unionByName, each), "null-scores"), every)


def null_tables(scored: DataFrame, every: int = 100) -> NullRun:
    """The tables of a null experiment from its scores, which may have been written and read again."""
    long = scored.unpivot(["selectivity", "query_id", "actual_selectivity", "subset_size"], list(METRICS.values()), "metric", "score").where(finite(F.col("score"))).withColumn("size", F.abs("score"))
    q = quantiles(long, "size", [0.5, 0.9, 0.95, 0.99, 1.0], ("selectivity", "metric")).withColumn("most", F.col("q")[4])
    sizes = q.select("selectivity", "metric", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("median", "q90", "q95", "q99"))], "most")
    largest = search.top_k(long.withColumn("of", F.struct("selectivity", "metric")), 10, by=F.col("size").desc(), of="of", tie="query_id").select("selectivity", "metric", "rank", "query_id", "size", "score", "actual_selectivity", "subset_size")
    actual = scored.groupBy("selectivity").agg(F.count("*").alias("queries"), F.avg("actual_selectivity").alias("actual_mean"), F.min("actual_selectivity").alias("actual_least"), F.max("actual_selectivity").alias("actual_most"))
    thresholds = sizes.groupBy("selectivity").pivot("metric", list(METRICS.values())).agg(F.first("q99"))
    summary = actual.join(thresholds, "selectivity", "left").withColumnsRenamed({c: f"{m}_tau_q99" for m, c in METRICS.items()})
    return NullRun(scored, summary, sizes, largest, null_history(scored, every))


def correlation_comparison(states: dict[str, State], ranges: dict[str, DataFrame], k: int) -> DataFrame:
    """scores() of the same queries with ranges of each class, with correlation_type. ranges: queries (query_id, qvec, lo, hi) of positive, negative and random; the last run on backend rand."""
    each = [scores(states["rand" if c == "random" else "corr"], q, k).drop("range_lo", "range_hi", "expected_random_gk_stderr").withColumn("correlation_type", F.lit(c)) for c, q in ranges.items()]
    return reduce(DataFrame.unionByName, each)


def classification(compared: DataFrame, selectivity: float) -> DataFrame:
    """(metric, tau, actual_class, negative, random, positive, metric_accuracy): predictions of each metric at its own threshold against the class that the true correlation has at
    its own; every class has a row. Scores that are null or not finite count as random."""
    at = lambda m: tau(F.lit(float(selectivity)), m)
    of = lambda c, t: F.when(finite(F.col(c)), class_of(F.col(c), t)).otherwise(F.lit("random"))
    rows = compared.withColumn("actual_class", of(METRICS["true"], at("true")))
    guess = [F.struct(F.lit(m).alias("metric"), at(m).alias("tau"), of(c, at(m)).alias("predicted")) for m, c in METRICS.items() if m != "true"]
    rows = rows.select("actual_class", F.explode(F.array(*guess)).alias("g")).select("actual_class", "g.*")
    share = rows.groupBy("metric", "tau").agg(F.avg((F.col("predicted") == F.col("actual_class")).cast("double")).alias("metric_accuracy"))
    counts = rows.groupBy("metric", "actual_class").pivot("predicted", list(CLASSES)).count()
    grid = share.withColumn("actual_class", F.explode(F.array(*map(F.lit, CLASSES))))
    return grid.join(counts, ["metric", "actual_class"], "left").na.fill(0, list(CLASSES)).select("metric", "tau", "actual_class", *CLASSES, "metric_accuracy")


def strategy_report(state: State, queries: DataFrame, options: SearchOptions = SearchOptions(), n_probe: int = 4) -> DataFrame:
    """One row a strategy and one of the planner: strategy, total_time_s, qps, recall_at_k, routing_time_s, execution_time_s, counts of routes and of correlation classes; what only the planner has is null elsewhere."""
    spark, n = state.base.sparkSession, queries.count()
    truth = search.ground_truth(state.base, queries, options.k).select("query_id", "vec_id").cache()
    truth.count()
    rows = []
    for name, answer in evaluate.strategies(state.base, state.cells, options, n_probe).items():
        began = time.perf_counter()
        got = answer(queries).cache()
        got.count()
        took = time.perf_counter() - began
        rows.append((name, took, n / max(took, 1e-9), search.recall(got, truth, queries).agg(F.avg("recall")).first()[0], *[None] * 8))
        got.unpersist()
    began = time.perf_counter()
    planned = evaluate.plan_queries(state.base, queries, state.cells).cache()
    planned.count()
    routing = time.perf_counter() - began
    got = router.routed(state.base, planned, state.cells, options, n_probe).cache()
    got.count()
    took = time.perf_counter() - began
    counts = planned.groupBy("plan", "correlation_type").agg(F.count("*").alias("n")).collect()
    by = lambda field, value: sum(r["n"] for r in counts if r[field] == value)
    recall = search.recall(got, truth, queries).agg(F.avg("recall")).first()[0]
    rows.append(("PLANNER", took, n / max(took, 1e-9), recall, routing, took - routing, *[by("plan", p) for p in ("PRE", "POST", "ACORN")], *[by("correlation_type", c) for c in ("positive", "random", "negative")]))
    for df in (got, planned, truth):
        df.unpersist()
    return spark.createDataFrame(rows, "strategy string, total_time_s double, qps double, recall_at_k double, routing_time_s double, execution_time_s double, pre_queries long, post_queries long, acorn_queries long, corr_positive long, corr_random long, corr_negative long")
