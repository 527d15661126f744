import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import calibrate, prefixes
from nearfield.operators.prefixes import prefix_quantiles, select_in_prefixes


@pytest.mark.parametrize("share", [0.99, 0.5, 0.0, 1.0])
def test_prefix_quantiles_against_numpy(spark, monkeypatch, share):
    monkeypatch.setattr(prefixes, "BLOCK", 500)
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(size=2300), "b": np.where(rng.random(2300) < 0.4, 0.25, rng.random(2300) * 1e-7), "c": np.full(40, 7.5)}
    rows = [(s, k + 1, None if (s == "b" and k < 150) else float(v)) for s, x in series.items() for k, v in enumerate(x)]
    points = [(s, p) for s in series for p in (1, 100, 499, 500, 501, 777, 1200, 2300)]
    got = {(r.series, r.at): r.tau for r in prefix_quantiles(spark.createDataFrame(rows, "series string, at long, v double"), spark.createDataFrame(points, "series string, at long"), share).collect()}
    want = {}
    for s, p in points:
        v = [x for t, at, x in rows if t == s and at <= p and x is not None]
        if v:
            want[s, p] = float(np.quantile(v, share))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-15) for k in want)


def test_ranks_inside_a_stripe(monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 50)
    rng = np.random.default_rng(4)
    at, v = rng.permutation(3000) + 1, rng.integers(0, 400, 3000).astype(float)
    points = rng.integers(1, 3001, 500)
    k = np.array([rng.integers(0, p) for p in points])
    want = [np.sort(v[at <= p])[i] for p, i in zip(points, k, strict=True)]
    assert select_in_prefixes(at, v, points, k).tolist() == want


def test_history_shuffles_rows_once(spark):
    """Rows sent are in proportion to the rows, not to rows times checkpoints."""
    scores = spark.range(20_000).select(F.col("id").alias("query_id"), (F.rand(5) - 0.5).alias("m"))
    got = calibrate.tau_history(scores, "m", 100).orderBy("processed").collect()
    v = np.abs([r.m for r in scores.orderBy("query_id").collect()])
    assert [r.processed for r in got] == list(range(100, 20_001, 100))
    assert all(math.isclose(r.tau, np.quantile(v[: r.processed], 0.99), rel_tol=1e-12) for r in got)
    assert calibrate.tau_history(scores.limit(0), "m", 100).collect() == []


def cloud(spark, n=3000, q=6):
    rnd = random.Random(7)
    base = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)], rnd.randrange(1000)) for i in range(n)], "vec_id long, vec array<double>, attr long")
    asked = [(i, [rnd.gauss(0, 1) for _ in range(4)], lo, lo + w) for i, (lo, w) in enumerate([(0, 999), (100, 50), (300, 5), (500, 400), (2000, 10), (10, 200)][:q])]
    return base, spark.createDataFrame(asked, "query_id long, qvec array<double>, lo long, hi long")


def test_true_correlation_needs_no_window_over_a_query(spark):
    base, q = cloud(spark)
    got = {r.query_id: r for r in calibrate.true_correlation(base, q, 5).collect()}
    dist = {}
    for r in calibrate.distances(base, q).collect():
        dist.setdefault(r.query_id, []).append(r.d)
    for i, d in dist.items():
        d, s, kk, n = np.sort(d), got[i].s, got[i].kk, len(d)
        if not s:
            assert got[i].e is None
            continue
        e = 0.0
        for j in range(1, kk + 1):
            p = [math.exp(lb(r - 1, j - 1) + lb(n - r, s - j) - lb(n, s)) if r >= j and n - r >= s - j else 0.0 for r in range(1, n + 1)]
            e += float(np.dot(p, d))
        assert math.isclose(got[i].e, e / kk, rel_tol=1e-9)
    plan = calibrate.expected_nearest_mean(calibrate.distances(base, q), calibrate.nearest_mean(calibrate.distances(base, q), q, 5))._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(query_id#" in plan
    assert all("stripe" in line for line in plan.splitlines() if "row_number() windowspecdefinition" in line and "AS r#" not in line and "rank#" not in line and "_we" in line and "d#" in line and "d2" not in line and "vec_id" in line and "(d#" not in line)


def lb(n, k):
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def test_drawn_ranks_follow_their_distribution(spark):
    sizes = spark.createDataFrame([(1, 200, 20, 3), (2, 10, 10, 4), (3, 50, 1, 1), (4, 7, 6, 5)], "query_id long, n long, s long, kk long")
    rows = calibrate.drawn_ranks(sizes, 4000).collect()
    by = {}
    for r in rows:
        by.setdefault((r.query_id, r.subset), []).append(r.r)
    n = {1: 200, 2: 10, 3: 50, 4: 7}
    assert all(x == sorted(set(x)) and 1 <= x[0] and x[-1] <= n[q] for (q, _), x in by.items())
    assert all(x == [1, 2, 3, 4] for (q, _), x in by.items() if q == 2)
    for q, size, s in ((1, 200, 20), (3, 50, 1), (4, 7, 6)):
        for j in range(len(by[q, 0])):
            x = np.array([v[j] for (p, _), v in by.items() if p == q])
            i, mean = j + 1, (j + 1) * (size + 1) / (s + 1)
            var = i * (size + 1) * (size - s) * (s + 1 - i) / ((s + 1) ** 2 * (s + 2))
            assert abs(x.mean() - mean) < 5 * math.sqrt(var / 4000) + 1e-9 and abs(x.var() - var) < 0.15 * var + 1e-9


def test_drawn_correlation_against_the_closed_form(spark):
    base, q = cloud(spark)
    exact = {r.query_id: r for r in calibrate.true_correlation(base, q, 5).collect()}
    got = {r.query_id: r for r in calibrate.drawn_correlation(base, q, 5, 256).collect()}
    assert got.keys() == {i for i, r in exact.items() if r.s}
    for i, r in got.items():
        assert abs(r.e - exact[i].e) < 5 * r.stderr + 1e-12
        if exact[i].s < 3000:
            assert math.isclose(r["corr"], (r.e - exact[i].g) / r.e, rel_tol=1e-9)
    assert got[0]["corr"] == 0.0 if exact[0].s == 3000 else True
