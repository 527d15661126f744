import numpy as np
from pyspark.sql import functions as F

from nearfield import catalogue
from nearfield.operators import graph, search

SF = "/root/testdata/sf0.1"


def share(got, want):
    """Share of the wanted pairs that were got."""
    return want.join(got, want.columns, "left_semi").count() / max(want.count(), 1)


def test_graph_and_search_on_the_vectors(spark):
    base = catalogue.base(spark, SF).select("vec_id", "vec", "attr", "cluster_id").cache()
    n = base.count()
    edges = graph.knn_graph(base, k=16)
    exact = search.top_k(search.all_pairs(base, base.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))).where("vec_id <> query_id").select("query_id", "vec_id", search.squared_l2("vec", "qvec").alias("d2")), 16)
    exact = exact.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("nbr"))
    assert edges.groupBy("vec_id").count().where("count = 16").count() == n and edges.where("vec_id = nbr").count() == 0
    assert share(edges.select("vec_id", "nbr"), exact) >= 0.9
    # ranges away from where the queries lie
    q = catalogue.asked(spark, SF).where("query_id % 100 = 0").selectExpr("query_id", "qvec", "(own + 500) % 1000 - 90 as lo", "(own + 500) % 1000 + 90 as hi")
    got = graph.filtered_search(base, edges, q, 5)
    truth = search.pre_filter(base, q, 5)
    assert share(got.select("query_id", "vec_id"), truth.select("query_id", "vec_id")) >= 0.9
    assert got.join(base.select("vec_id", "attr"), "vec_id").join(q.select("query_id", "lo", "hi"), "query_id").where("attr not between lo and hi").count() == 0
    assert got.agg(F.avg("scored")).first()[0] < 0.5 * n


def test_small_graphs(spark):
    kind = "vec_id long, vec array<double>"
    assert graph.knn_graph(spark.createDataFrame([], kind)).collect() == []
    assert graph.knn_graph(spark.createDataFrame([(4, [1.0])], kind)).collect() == []
    x = np.random.default_rng(3).normal(size=(9, 2))
    x[4] = x[5]
    rows = [(i * 10, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0, 0.0]), (7, None)]
    got = sorted((r.vec_id, r.nbr, round(r.d2, 9)) for r in graph.knn_graph(spark.createDataFrame(rows, kind), k=16).collect())
    assert got == sorted((i * 10, j * 10, round(float(((x[i] - x[j]) ** 2).sum()), 9)) for i in range(9) for j in range(9) if i != j)


def test_cells_with_many_copies(spark, monkeypatch):
    """Rows in several cells a round: nearly all neighbours are found, copies of one vector have copies as neighbours, and no cell holds all copies."""
    monkeypatch.setattr(graph, "CELL", 256)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6))
    x[::5] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>").cache()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    far = np.sort(d, axis=1)[:, 7]
    got = graph.knn_graph(table, k=8).toPandas()
    assert (got.groupby("vec_id").size() == 8).all() and (got.vec_id != got.nbr).all() and not got.duplicated(["vec_id", "nbr"]).any()
    assert np.allclose(got.d2, d[got.vec_id, got.nbr])
    assert (got.d2 <= far[got.vec_id] + 1e-12).mean() >= 0.9
    # with 71 pivots about 14 stand on the copies' vector
    monkeypatch.setattr(graph, "CELL", 64)
    cells = graph._cells(table, 1500, 3, 0).where("vec_id % 5 = 0").groupBy("cell").count().agg(F.max("count")).first()[0]
    assert cells < 300


def test_narrow_ranges_far_from_the_query(spark):
    """Ranges of few rows in a group of vectors that no edge joins to the query's are answered in full."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 4))
    x[:, 0] += 100 * (np.arange(3000) // 1000)
    table = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "vec_id long, vec array<double>, attr long")
    q = spark.createDataFrame([(i, x[i].tolist(), lo, lo + w) for i, lo, w in ((3, 2500, 6), (50, 1203, 3), (1100, 40, 11), (7, 1000, 900), (9, 5000, 10), (12, 30, 10))], "query_id long, qvec array<double>, lo long, hi long")
    got = graph.filtered_search(table, graph.knn_graph(table, k=8), q, 5).select("query_id", "rank", "vec_id")
    want = search.pre_filter(table, q, 5).select("query_id", "rank", "vec_id")
    assert sorted(got.collect()) == sorted(want.collect())
