"""Trained and smoothed structures: cells by k-means, principal components, attributes that follow the vectors."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import gaussian, l2, squared_l2
from nearfield.operators.search import all_pairs, small
from nearfield.operators.workload import MOD, draw
from nearfield.tables import written

SMOOTHING_STEPS, KEEP = 12, 0.2


def n_cells(n: int) -> int:
    """The root of the number of rows, between 32 and 256."""
    return max(32, min(256, math.isqrt(n)))


def kmeans_cells(vectors: DataFrame, k: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(vec_id, vec, cluster_id) and (cluster_id, centroid) of k cells; written with partitionBy(cluster_id) and sorted by attribute, they are the table that probe() prunes."""
    v = vectors.withColumn("features", array_to_vector(F.transform("vec", lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, maxIter=15).fit(v)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    own = model.transform(v).select("vec_id", "vec", F.col("prediction").alias("cluster_id"))
    return own, vectors.sparkSession.createDataFrame(centres, "cluster_id int, centroid array<double>")


def principal_components(vectors: DataFrame, n: int) -> DataFrame:
    """(vec_id, c1..cn): centred projections; signs are arbitrary."""
    v = vectors.withColumn("raw", array_to_vector(F.transform("vec", lambda x: x.cast("double"))))
    mean = v.select(Summarizer.mean(F.col("raw")).alias("m")).first().m.toArray().tolist()
    centred = F.zip_with(vector_to_array("raw"), F.lit(mean), lambda x, m: x - m)
    v = v.withColumn("features", array_to_vector(centred))
    out = PCA(k=n, inputCol="features", outputCol="pc").fit(v).transform(v)
    return out.select("vec_id", *[vector_to_array("pc")[i].alias(f"c{i + 1}") for i in range(n)])


def local_sigma(vectors: DataFrame, centres: DataFrame, scale: float = 1.0, sample: int = 10_000) -> float:
    """Median distance to the second nearest centroid over at most sample rows by hash, by scale."""
    some = vectors.orderBy(draw(F.col("vec_id"), 9), "vec_id").limit(sample)
    d = some.crossJoin(small(centres)).select("vec_id", l2("vec", "centroid").alias("d"))
    second = d.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy("d"))).where("r = 2")
    return float(second.agg(F.percentile("d", 0.5)).first()[0] or 1.0) * scale


def blended_attribute(vectors: DataFrame, anchors: DataFrame, sigma: float, most: int = 1000) -> DataFrame:
    """(vec_id, attr): anchors (cluster_id, centroid, anchor) blended by Gaussian weights of the distance, spread over 0..most; all alike gives the middle."""
    w = gaussian(squared_l2("vec", "centroid"), F.lit(sigma))
    a = vectors.crossJoin(small(anchors)).select("vec_id", "anchor", w.alias("w")).groupBy("vec_id").agg((F.sum(F.col("w") * F.col("anchor")) / F.greatest(F.sum("w"), F.lit(1e-12))).alias("a"))
    ends = a.agg(F.min("a").alias("low"), F.max("a").alias("high"))
    unit = F.when(F.col("high") > F.col("low"), (F.col("a") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.5))
    return a.crossJoin(F.broadcast(ends)).select("vec_id", F.bround(most * unit).cast("long").alias("attr"))


def smoothing_graph(centres: DataFrame) -> DataFrame:
    """(cluster_id, nbr, w): each centroid's nearest others, about the root of their number, with Gaussian weights of the distance, and itself with 1, made shares. Ties go to the smaller cluster."""
    x = centres.select(F.col("cluster_id").alias("vec_id"), F.col("centroid").alias("vec"))
    pairs = all_pairs(x, x.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))).where("vec_id <> query_id")
    k = F.count("*").cast("long")
    some = F.least(F.greatest(F.lit(3), F.least(F.col("k") - 1, F.ceil(F.sqrt("k")))), F.col("k") - 1)
    size = centres.agg(k.alias("k")).select(some.alias("some"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))
    near = pairs.select("query_id", "vec_id", squared_l2("vec", "qvec").alias("d2")).withColumn("r", rank).crossJoin(F.broadcast(size)).where(F.col("r") <= F.greatest("some", F.lit(1))).drop("some")
    near = written(near, "near-centroids")
    sigma = near.where("r = 1").agg(F.greatest(F.percentile(F.sqrt("d2"), 0.5), F.lit(1e-9)).alias("sigma"))
    w = near.crossJoin(F.broadcast(sigma)).select(F.col("query_id").alias("cluster_id"), F.col("vec_id").alias("nbr"), F.exp(-F.col("d2") / (2 * F.col("sigma") ** 2)).alias("w"))
    w = w.unionByName(centres.select("cluster_id", F.col("cluster_id").alias("nbr"), F.lit(1.0).alias("w")))
    return w.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("cluster_id")))


def smoothed_anchors(centres: DataFrame, seed: int = 12, steps: int = SMOOTHING_STEPS, keep: float = KEEP) -> DataFrame:
    """(cluster_id, centroid, anchor): anchors drawn by a hash of cluster_id, smoothed over the nearest centroids' graph and spread over 0..1; all alike gives the middle, one alone its draw.

    A step is a join with the edges and a sum. Runs jobs: the edges and every third step are tables.
    """
    start = centres.select("cluster_id", ((draw(F.col("cluster_id"), seed) + 0.5) / MOD).alias("start"))
    edges, a = written(smoothing_graph(centres), "edges"), start.withColumnRenamed("start", "a")
    for t in range(steps):
        sent = edges.join(a.select(F.col("cluster_id").alias("nbr"), "a"), "nbr").groupBy("cluster_id").agg(F.sum(F.col("w") * F.col("a")).alias("a"))
        a = sent.join(start, "cluster_id").select("cluster_id", ((1 - keep) * F.col("a") + keep * F.col("start")).alias("a"))
        a = written(a, "anchors") if t % 3 == 2 else a
    ends = a.agg(F.min("a").alias("low"), F.max("a").alias("high"), F.count("*").alias("k"))
    unit = F.when(F.col("k") == 1, F.col("start")).when(F.col("high") > F.col("low"), (F.col("a") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.5))
    return centres.join(a.join(start, "cluster_id").crossJoin(F.broadcast(ends)).select("cluster_id", unit.alias("anchor")), "cluster_id").select("cluster_id", "centroid", "anchor")


def linked_correlated_attribute(vectors: DataFrame, k: int = 10, seed: int = 0, sigma_scale: float = 1.0) -> DataFrame:
    """(vec_id, attr) from cells, smoothed anchors and blending: an attribute that follows the vectors."""
    _, centres = kmeans_cells(vectors, k, seed)
    return blended_attribute(vectors, smoothed_anchors(centres, seed), local_sigma(vectors, centres, sigma_scale))
