"""Blocked searches against plain numpy: ties, copies, parts and blocks of few rows, odd vectors."""

import math

import numpy as np
import pytest

from nearfield.operators import blocks, search
from nearfield.operators.search import SearchOptions

BASE, QUERIES = "vec_id long, vec array<double>, attr double, cluster_id int", "query_id long, qvec array<double>, lo double, hi double"


@pytest.fixture
def tiny(monkeypatch):
    """Parts of few rows and blocks of few queries."""
    monkeypatch.setattr(blocks, "ROWS", 23)
    monkeypatch.setattr(blocks, "QUERIES", 5)
    monkeypatch.setattr(blocks, "TILE", 2)
    monkeypatch.setattr(blocks, "ANEW", 64)


def cloud(spark, n=160, seed=3):
    """Vectors of few different components, so that distances are equal often, with copies; a value of the attribute that most rows have."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-1, 2, (n, 4)) / 3.0
    x[n // 2 :] = x[: n - n // 2]
    attr = np.where(rng.random(n) < 0.5, 7.0, rng.integers(0, 20, n))
    base = spark.createDataFrame([(i, x[i].tolist(), float(attr[i]), i % 3) for i in range(n)], BASE)
    asked = [(10 * i, x[10 * i].tolist(), *sorted(map(float, rng.integers(0, 20, 2)))) for i in range(n // 10)]
    asked[0] = (*asked[0][:2], -math.inf, math.inf)
    return x, attr, base, asked, spark.createDataFrame(asked, QUERIES)


def order(x, v, inner=False):
    s = np.zeros(len(x))
    for c in range(x.shape[1]):
        s += -x[:, c] * v[c] if inner else (x[:, c] - v[c]) ** 2
    return np.lexsort((np.arange(len(x)), s)), s


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())


def test_unfiltered(spark, tiny):
    x, _, base, asked, q = cloud(spark)
    assert got(search.knn(base, q, 7)) == sorted((a[0], r + 1, int(i)) for a in asked for r, i in enumerate(order(x, a[1])[0][:7]))
    want = sorted((a[0], r + 1, int(i)) for a in asked for r, i in enumerate([i for i in order(x, a[1], True)[0] if i != a[0]][:7]))
    assert got(search.knn_self_by_inner(base, q, 7)) == want


def test_filtered(spark, tiny):
    x, attr, base, asked, q = cloud(spark)
    want = sorted((a[0], r + 1, int(i)) for a in asked for r, i in enumerate([i for i in order(x, a[1])[0] if a[2] <= attr[i] <= a[3]][:4]))
    assert got(search.pre_filter(base, q, 4)) == got(search.ground_truth(base, q, 4)) == want
    assert got(search.probe(base, q, search.centroids(base), 4, 3)) == want
    assert got(search.post_filter(base, q, SearchOptions(k=4))) == want


def test_overall_ranks(spark, tiny):
    x, _, base, asked, q = cloud(spark)
    wanted = {a[0]: sorted((int(order(x, a[1])[0][p]), p + 1) for p in (0, 3, 50, 159)) for a in asked}
    hits = spark.createDataFrame([(k, i, float(order(x, dict((a[0], a[1]) for a in asked)[k])[1][i])) for k, v in wanted.items() for i, _ in v], "query_id long, vec_id long, d2 double")
    found = {}
    for r in search.ranks_overall(base, q, hits).collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.pos))
    assert {k: sorted(v) for k, v in found.items()} == wanted


def test_odd_vectors(spark, tiny):
    rows = [(1, [0.0, 0.0], 1.0, 0), (2, None, 1.0, 0), (3, [1.0, None], 1.0, 0), (4, [1.0], 1.0, 0), (5, [math.inf, 0.0], 1.0, 0), (6, [1e150, 0.0], 1.0, 0), (7, [math.nan, 0.0], 1.0, 0), (8, [3.0, 4.0], math.nan, 0), (9, [1.0, 1.0], None, 0)]
    base = spark.createDataFrame(rows, BASE)
    q = spark.createDataFrame([(1, [0.0, 0.0], 0.0, 2.0), (2, [0.0, 0.0], 0.0, math.nan), (3, None, 0.0, 2.0), (4, [0.0, 0.0], 2.0, 1.0)], QUERIES)
    assert [r.vec_id for r in search.knn(base, q.where("query_id = 1"), 9).orderBy("rank").collect()] == [1, 9, 8, 6, 5, 7]
    assert got(search.pre_filter(base, q, 9)) == [(1, 1, 1), (1, 2, 6), (1, 3, 5), (1, 4, 7), (2, 1, 1), (2, 2, 8), (2, 3, 6), (2, 4, 5), (2, 5, 7)]


def test_no_pair_is_a_row(spark):
    _, _, base, _, q = cloud(spark)
    for found in (search.knn(base, q, 3), search.knn_self_by_inner(base, q, 3), search.pre_filter(base, q, 3), search.ground_truth(base, q, 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_calibration_without_pairs(spark, tiny, monkeypatch):
    from nearfield.operators import calibrate

    _, _, base, _, q = cloud(spark)
    dist = calibrate.distances(base, q)
    near = calibrate.nearest_mean(dist, q, 3)
    rows = lambda df: {r[0]: tuple(r)[1:] for r in df.collect()}
    same = lambda a, b: a.keys() == b.keys() and all(x == (pytest.approx(y) if y is not None else None) for k in a for x, y in zip(a[k], b[k], strict=True))
    assert same(rows(calibrate.admissible(base, q, 3)), rows(near.select("query_id", "s", "kk", "g")))
    assert same(rows(calibrate.expected_mean(base, q, calibrate.admissible(base, q, 3))), rows(calibrate.expected_nearest_mean(dist, near)))
    means = calibrate._subset_means(dist, near.where("s > 0"), 3, 4).groupBy("query_id").agg(calibrate.F.avg("m").alias("e"))
    assert same(rows(calibrate.sampled_correlation(base, q, 3, 4).select("query_id", "e")), rows(means))
    # too few rows looked at: the rest is settled from all rows
    monkeypatch.setattr(calibrate, "reach", lambda kk, n, s, nats: kk)
    assert same(rows(calibrate.sampled_correlation(base, q, 3, 4).select("query_id", "e")), rows(means))


def test_places_by_hash_with_equal_hashes(spark, tiny):
    from nearfield.operators import calibrate

    ids = [5, 5 + calibrate.MOD, 5 + 2 * calibrate.MOD, 6, 7, 8]
    base = spark.createDataFrame([(i,) for i in ids], "vec_id long")
    pairs = spark.createDataFrame([(3, 1)], "query_id long, subset long").crossJoin(base)
    rows = pairs.withColumn("u", calibrate.draw(calibrate.F.col("vec_id") + calibrate.draw(calibrate.F.col("query_id") + calibrate.draw(calibrate.F.col("subset"), 6), 6), 6))
    order = [r.vec_id for r in rows.orderBy("u", "vec_id").collect()]
    assert [r.vec_id for r in calibrate.hash_places(base, rows).orderBy("before").collect()] == order
    assert sorted(r.before for r in calibrate.hash_places(base, rows).collect()) == list(range(6))
