import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import catalogue
from nearfield.operators import search, workload


@pytest.mark.parametrize("size", [50, 64, 100])
def test_draws_with_replacement_vary_as_they_should(spark, size):
    """How often rows are drawn varies as independent draws do, whatever the size of the pool; a lattice would give each row the same number."""
    pool, n = spark.range(size).withColumnRenamed("id", "query_id"), 6400
    times = np.zeros(size)
    for r in workload.sample_with_replacement(pool, n).groupBy("query_id").count().collect():
        times[r.query_id] = r["count"]
    expected = n / size
    assert times.sum() == n
    assert 0.55 < times.var() / (expected * (1 - 1 / size)) < 1.6


def test_draw_has_no_lattice(spark):
    x = np.array([r.d for r in spark.range(4096).select(workload.draw(F.col("id"), 3).alias("d")).collect()])
    assert x.min() >= 0 and x.max() < 2**31
    for bits in (1, 4, 8):
        low = x % 2**bits
        repeats = (low[1:] == low[:-1]).mean()
        assert abs(repeats - 2.0**-bits) < 5 * np.sqrt(2.0**-bits / 4096)
    assert abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.08


def test_value_at_positions(spark):
    values = [3, 3, 3, 5, 8, 8, 9]
    pos = workload.positions(spark.createDataFrame([(v,) for v in values], "attr long"))
    q = spark.range(len(values)).withColumnRenamed("id", "at")
    assert [r.v for r in workload.value_at(q, pos, "at", "v").orderBy("at").collect()] == values


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_probe(spark, sf):
    recall = catalogue.QUERIES["recall_at_k"](spark, f"/root/testdata/{sf}").agg(F.avg("recall")).first()[0]
    assert recall >= 0.9


def test_ladder_that_ends_early_is_completed(spark):
    """Rows in range that lie beyond the most that is fetched are found by the exact search, or left out where that is asked for."""
    base = spark.createDataFrame([(i, [float(i)], int(i >= 90), 0) for i in range(100)], "vec_id long, vec array<double>, attr long, cluster_id int")
    q = spark.createDataFrame([(7, [0.0], 1, 1), (8, [0.0], 5, 9)], "query_id long, qvec array<double>, lo long, hi long")
    got = search.post_filter(base, q, search.SearchOptions(k=3, max_fetch_k=20)).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.fetched) for r in got] == [(7, 90, 20), (7, 91, 20), (7, 92, 20)]
    assert search.post_filter(base, q, search.SearchOptions(k=3, max_fetch_k=20, complete=False)).collect() == []
