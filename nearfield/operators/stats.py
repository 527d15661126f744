"""Selectivity, histograms and cluster statistics of an attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.scalars import bin_index, freedman_diaconis, js_distance
from nearfield.operators.quantiles import quantiles
from nearfield.operators.ranks import counted
from nearfield.operators.search import small

SMOOTH = 1e-3


def value_counts(base: DataFrame, attr: str = "attr") -> DataFrame:
    """(v, n): rows of each value."""
    return base.groupBy(F.col(attr).alias("v")).agg(F.count("*").alias("n"))


def selectivity(base: DataFrame, queries: DataFrame, attr: str = "attr") -> DataFrame:
    """(query_id, m, selectivity): exact share of rows in each query's [lo, hi], as the difference of two lookups in counts of values, which are a table: it runs a job. Reversed or null ends hold no rows."""
    counts = value_counts(base, attr)
    total = base.agg(F.count("*").alias("total"))
    q = queries.select("query_id", "lo", "hi")
    q = counted(q, counts, {"hi": ("upto", True), "lo": ("below", False)})
    m = q.select("query_id", F.when(F.col("lo") <= F.col("hi"), F.col("upto") - F.col("below")).otherwise(F.lit(0)).cast("long").alias("m"))
    return m.crossJoin(F.broadcast(total)).select("query_id", "m", F.when(F.col("total") > 0, F.col("m") / F.col("total")).otherwise(F.lit(0.0)).alias("selectivity"))


def realised(ranges: DataFrame, selectivity: str = "actual") -> DataFrame:
    """One row (n, mean, least, most) of the selectivities that ranges really have."""
    return ranges.agg(F.count(selectivity).alias("n"), F.avg(selectivity).alias("mean"), F.min(selectivity).alias("least"), F.max(selectivity).alias("most"))


def choose_bins(base: DataFrame, attr: str = "attr") -> DataFrame:
    """One row (n, low, high, iqr, bins): a number of bins by spread and size, between 20 and 200. Runs a job; without values n is 0 and the rest null."""
    q = base.agg(F.count(attr).alias("n"), F.min(attr).cast("double").alias("low"), F.max(attr).cast("double").alias("high"))
    q = q.join(F.broadcast(quantiles(base, attr, [0.25, 0.75]).select("q")), how="left")  # one row, or none
    q = q.select("n", "low", F.when(F.col("high") == F.col("low"), F.col("low") + 1).otherwise(F.col("high")).alias("high"), (F.col("high") - F.col("low")).alias("span"), (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    bins = F.when(F.col("span") == 0, F.lit(1)).otherwise(freedman_diaconis(F.col("n"), F.col("low"), F.col("high"), F.col("iqr")))
    return q.select("n", "low", "high", "iqr", bins.cast("long").alias("bins"))


def histogram(base: DataFrame, bins: DataFrame, attr: str = "attr", by: str | None = None, smooth: float = SMOOTH) -> DataFrame:
    """(by, bin, p, cdf): density of equal bins plus a constant, made shares, and their running sum. by: a column of groups, or none.

    bins: choose_bins(). Every bin is there for every group.
    """
    keys = [by] if by else []
    b = F.broadcast(bins)
    counted = base.crossJoin(b).select(*keys, bin_index(F.col(attr), F.col("low"), F.col("high"), F.col("bins")).cast("long").alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    grid = (counted.select(*keys).distinct().crossJoin(b) if by else b).select(*keys, "low", "high", "bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    full = grid.join(counted, [*keys, "bin"], "left").na.fill(0, ["c"])
    group = Window.partitionBy(*keys)
    density = F.col("c") / (F.sum("c").over(group) * (F.col("high") - F.col("low")) / F.col("bins")) + smooth
    full = full.withColumn("d", density).withColumn("p", F.col("d") / F.sum("d").over(group))
    return full.select(*keys, "bin", "p", F.sum("p").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cdf"))


def within_radius(vectors: DataFrame, centres: DataFrame, slack: float = 1.3) -> DataFrame:
    """The members (vec_id, vec, cluster_id) no farther from their centroid than slack times the farthest."""
    from nearfield.functions.vectors import l2

    d = vectors.join(small(centres), "cluster_id").withColumn("dist", l2("vec", "centroid")).drop("centroid")
    most = d.groupBy("cluster_id").agg((slack * F.max("dist")).alias("radius"))
    return d.join(F.broadcast(most), "cluster_id").where("dist <= radius").drop("radius", "dist")  # a row per cluster


def as_arrays(hist: DataFrame, by: str | None = None) -> DataFrame:
    """(by, p array, cdf array) in order of bins."""
    rows = F.array_sort(F.collect_list(F.struct("bin", "p", "cdf")))
    out = (hist.groupBy(by) if by else hist.groupBy()).agg(rows.alias("r"))
    return out.select(*([by] if by else []), F.transform("r", lambda r: r["p"]).alias("p"), F.transform("r", lambda r: r["cdf"]).alias("cdf"))


def cluster_divergence(cluster_hist: DataFrame, global_hist: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(cluster_id, js, p, cdf, gp, gcdf): Jensen-Shannon distance of each cluster's shares to all rows'."""
    c, g = as_arrays(cluster_hist, "cluster_id"), as_arrays(global_hist).select(F.col("p").alias("gp"), F.col("cdf").alias("gcdf"))

    def shares(p):
        return F.transform(p, lambda x: (x + eps) / F.aggregate(p, F.lit(0.0), lambda s, y: s + y + eps))

    return c.crossJoin(F.broadcast(g)).select("cluster_id", js_distance(shares(F.col("p")), shares(F.col("gp"))).alias("js"), "p", "cdf", "gp", "gcdf")
