"""Jobs for spark-submit: python -m nearfield.jobs {null,plan,compare,estimate,interpolate} ... Tables are Parquet, reports CSV and Markdown."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import calibrate, workload
from nearfield.operators.search import SearchOptions
from nearfield.plans import experiments, states
from nearfield.session import ship
from nearfield.sources import files
from nearfield.tables import written


# Names, choices and defaults of the options that runs are called with.
def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    null = jobs.add_parser("null", help="null scores, and thresholds by selectivity")
    plan = jobs.add_parser("plan", help="strategies and planner over a workload of random ranges")
    compare = jobs.add_parser("compare", help="correlations of ranges near, away from and regardless of the queries, predictions counted, strategies by class")
    for p in (null, plan, compare):
        p.add_argument("--vectors", required=True, help="Parquet of (vec_id, vec)")
        p.add_argument("--queries", required=True, help="Parquet of (query_id, qvec)")
        p.add_argument("--out", required=True)
        p.add_argument("--k-eval", type=int, default=100)
    null.add_argument("--selectivities", type=experiments.parse_selectivities, default="0.001,0.01,0.1,0.5")
    null.add_argument("--num-samples", type=int, default=10_000)
    null.add_argument("--monte-carlo-subsets", type=int, default=32)
    null.add_argument("--progress-every", type=int, default=100)
    null.add_argument("--interp-degree", type=int, default=2)
    plan.add_argument("--sel", type=float, default=0.01)
    plan.add_argument("--n-queries", type=int, default=100)
    plan.add_argument("--n-probe", type=int, default=4)
    plan.add_argument("--backend", choices=("corr", "rand"), default="corr")
    compare.add_argument("--sel", type=float, default=0.01)
    compare.add_argument("--n-queries", type=int, default=10, help="queries of each class")
    compare.add_argument("--neighbours", type=int, default=100)
    compare.add_argument("--n-probe", type=int, default=4)
    compare.add_argument("--performance", action="store_true", help="also run every strategy on every class")
    estimate = jobs.add_parser("estimate", help="thresholds that tell the classes of a comparison apart")
    estimate.add_argument("--input", required=True, help="comparison CSV")
    estimate.add_argument("--out", required=True)
    estimate.add_argument("--objective", choices=("accuracy", "balanced_accuracy", "macro_f1"), default="balanced_accuracy")
    estimate.add_argument("--metric", choices=("all", *experiments.METRICS), default="all")
    estimate.add_argument("--num-points", type=int, default=400)
    interpolate = jobs.add_parser("interpolate", help="thresholds at other selectivities")
    interpolate.add_argument("--root", required=True, help="folder of summary CSVs")
    interpolate.add_argument("--out", required=True)
    interpolate.add_argument("--metric", choices=tuple(experiments.METRICS), default="tanh")
    interpolate.add_argument("--degree", type=int, default=2)
    interpolate.add_argument("--grid", type=experiments.parse_selectivities, default="0.001,0.01,0.1,0.5")
    return parser


def null(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes scores, summary, quantiles, largest, history and the fitted thresholds below out; returns the summary."""
    state = states.vector_states(spark.read.parquet(a.vectors))["rand"]
    run = experiments.null_experiment(state, spark.read.parquet(a.queries), a.selectivities, a.num_samples, a.k_eval, a.monte_carlo_subsets, a.progress_every)
    run.scores.write.mode("overwrite").parquet(f"{a.out}/scores")
    run = experiments.null_tables(spark.read.parquet(f"{a.out}/scores"), a.progress_every)
    for name in ("summary", "quantiles", "largest", "history"):
        files.write_report(getattr(run, name), f"{a.out}/{name}")
    grid = spark.createDataFrame([(s,) for s in a.selectivities], "selectivity double")
    for m in experiments.METRICS:
        points = run.summary.select("selectivity", F.col(f"{m}_tau_q99").alias("tau")).where("tau is not null")
        files.write_report(calibrate.interpolated(grid, calibrate.fit_tau(points, a.interp_degree)), f"{a.out}/fit_{m}")
    return run.summary


def plan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes the table of strategies; returns it."""
    state = states.vector_states(spark.read.parquet(a.vectors))[a.backend]
    queries = workload.drawn_queries(spark.read.parquet(a.queries), a.n_queries)
    ranges = workload.rejection_ranges(state.base, queries, a.sel).select("query_id", "lo", "hi")
    report = experiments.strategy_report(state, queries.select("query_id", "qvec").join(ranges, "query_id"), SearchOptions(k=a.k_eval), a.n_probe)
    files.write_report(report, a.out)
    return report


def compare(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes the comparison of the classes, the counts of each metric's predictions and, if wanted, a table of strategies for each class; returns the counts."""
    both = states.vector_states(spark.read.parquet(a.vectors))
    pool = written(workload.drawn_queries(spark.read.parquet(a.queries), a.n_queries).select("query_id", "qvec"), "compared-queries")
    near = written(workload.correlated_ranges(both["corr"].base, pool, a.sel, a.neighbours), "correlated-ranges")
    of = {"positive": near.selectExpr("query_id", "pos_lo as lo", "pos_hi as hi"), "negative": near.selectExpr("query_id", "neg_lo as lo", "neg_hi as hi"), "random": workload.random_ranges(both["rand"].base, pool, a.sel)}
    ranges = {name: pool.join(r, "query_id") for name, r in of.items()}
    compared = written(experiments.correlation_comparison(both, ranges, a.k_eval), "comparison")
    files.write_report(compared.orderBy("correlation_type", "query_id"), f"{a.out}/comparison")
    counts = written(experiments.classification(compared, a.sel), "classification")
    files.write_report(counts.orderBy("metric", "actual_class"), f"{a.out}/classification")
    for m in (m for m in experiments.METRICS if m != "true"):
        files.write_report(counts.where(F.col("metric") == m).select("actual_class", *experiments.CLASSES).orderBy("actual_class"), f"{a.out}/matrix_{m}")
    if a.performance:
        for name, q in ranges.items():
            files.write_report(experiments.strategy_report(both["rand" if name == "random" else "corr"], q, SearchOptions(k=a.k_eval), a.n_probe), f"{a.out}/performance_{name}")
    return counts


def estimate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes the sweep of each metric and the table of the best thresholds; returns the latter."""
    wanted = {m: c for m, c in experiments.METRICS.items() if a.metric in ("all", m)}
    rows = files.read_comparison(spark, a.input, tuple(wanted.values())).cache()
    best = None
    for m, c in wanted.items():
        swept = calibrate.sweep(rows, c, a.num_points).cache()
        files.write_report(swept.orderBy("tau"), f"{a.out}/sweep_{m}")
        one = calibrate.best_tau(swept, a.objective).withColumn("metric", F.lit(m))
        best = one if best is None else best.unionByName(one)
    files.write_report(best, f"{a.out}/best")
    return best


def interpolate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes the points and the thresholds at the grid's selectivities; returns the latter."""
    points = files.read_tau_points(spark, a.root, a.metric)
    files.write_report(points, f"{a.out}/points")
    grid = spark.createDataFrame([(s,) for s in a.grid], "selectivity double")
    out = calibrate.interpolated(grid, calibrate.fit_tau(points, a.degree))
    files.write_report(out, f"{a.out}/curve")
    return out


def main(argv: list[str] | None = None) -> None:
    a = _arguments().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    job = {"null": null, "plan": plan, "compare": compare, "estimate": estimate, "interpolate": interpolate}[a.job]
    print(files.markdown(job(spark, a)))


if __name__ == "__main__":
    main()
