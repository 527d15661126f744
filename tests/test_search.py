import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.operators import search
from nearfield.operators.search import SearchOptions
from nearfield.plans import evaluate, router

BASE, QUERIES = "vec_id long, vec array<double>, attr long, cluster_id int", "query_id long, qvec array<double>, lo long, hi long"


def ladder(matches, n, k, options):
    """The over-fetch rule, step by step: which positions come back, how many were fetched, and retries."""
    hits = set(matches)
    if not hits:
        return [], 0, 0
    fetch = int(min(max(k, min(np.ceil(k / max(len(hits) / n, 1e-6) * options.fetch_mult), options.max_fetch_k)), n))
    cap, target, tries = min(options.max_fetch_k, n), max(k, min(len(hits), int(np.ceil(k * options.min_valid_mult)))), 0
    while True:
        found, seen = [], 0
        for p in range(fetch):
            if p in hits and len(found) < k:
                found.append(p)
        seen = min(target, len(found) + sum(p in hits for p in range(min(k, fetch), fetch)))
        if (len(found) >= k and seen >= target) or tries >= options.max_retries or fetch >= cap:
            return found, fetch, tries
        fetch, tries = min(cap, 2 * fetch), tries + 1


CASES = {"A": ([0, *range(24, 64)], [0, 24], 28, 2), "B": ([10, 11, *range(40, 64)], [10, 11], 20, 1), "C": ([0, 1, 2, 39], [0, 1], 64, 0), "D": ([], [], 0, 0)}


@pytest.mark.parametrize("case", CASES)
def test_ladder_by_hand(spark, case):
    matches, out, fetched, retries = CASES[case]
    base = spark.createDataFrame([(i, [float(i)], int(i in matches), 0) for i in range(64)], BASE)
    q = spark.createDataFrame([(7, [0.0], 1, 1)], QUERIES)
    o = SearchOptions(k=2, max_fetch_k=200)
    got = sorted((r["rank"], r.vec_id, r.fetched, r.retries) for r in search.post_filter(base, q, o).collect())
    assert [g[1] for g in got] == out
    assert all(g[2:] == (fetched, retries) for g in got)
    assert ladder(matches, 64, 2, o) == (out, fetched, retries)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 99), max_size=60), st.integers(1, 12))
def test_ladder_rule_finds_what_there_is(matches, k):
    found, fetched, _ = ladder(matches, 100, k, SearchOptions(k=k, max_fetch_k=200, max_retries=9))
    assert found == sorted(matches)[: len(found)]
    assert len(found) == min(k, len(matches))


def cloud(spark, n=300, d=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d)) * 4
    label = rng.integers(0, 4, n)
    x = centres[label] + rng.normal(size=(n, d))
    attr = (label * 100 + rng.integers(0, 100, n)).astype(int)
    base = spark.createDataFrame([(i, x[i].tolist(), int(attr[i]), int(label[i])) for i in range(n)], BASE)
    asked = [(1000 + i, (centres[i % 4] + rng.normal(size=d)).tolist(), *sorted(map(int, rng.integers(0, 400, 2)))) for i in range(12)]
    return x, attr, base, asked, spark.createDataFrame(asked, QUERIES)


def exact(x, attr, asked, k):
    out = []
    for q, v, lo, hi in asked:
        ok = np.flatnonzero((attr >= lo) & (attr <= hi))
        d = ((x[ok] - np.array(v)) ** 2).sum(1)
        out += [(q, r + 1, int(ok[i])) for r, i in enumerate(np.lexsort((ok, d))[:k])]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())


def test_exact_strategies_agree_with_numpy(spark):
    x, attr, base, asked, q = cloud(spark)
    want = exact(x, attr, asked, 5)
    assert rows(search.pre_filter(base, q, 5)) == want
    assert rows(search.ground_truth(base, q, 5)) == want
    assert rows(search.post_filter(base, q, SearchOptions(k=5))) == want
    assert rows(search.probe(base, q, search.centroids(base), 5, 4)) == want


def test_recall_of_probes_and_empty_truth(spark):
    _, _, base, _, q = cloud(spark)
    q = q.unionByName(spark.createDataFrame([(1, [0.0] * 6, 900, 950)], QUERIES))
    truth = search.pre_filter(base, q, 5)
    one, four = (search.recall(search.probe(base, q, search.centroids(base), 5, n), truth, q).agg(F.avg("recall")).first()[0] for n in (1, 4))
    assert one <= four == 1.0
    wrong = spark.createDataFrame([(1, 5)], "query_id long, vec_id long")
    assert search.recall(wrong, truth, q).where("query_id = 1").first().recall == 0.0


def test_range_join_is_an_equi_join(spark):
    _, _, base, _, q = cloud(spark)
    plan = search.range_join(base, q)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_routes(spark):
    planned = spark.createDataFrame([(0.02, 0.0), (0.2, -0.2), (0.2, 0.2), (0.4, -0.9), (0.049, 0.0), (0.05, -0.2), (0.05, 0.2)], "selectivity double, heuristic double")
    assert [r.plan for r in router.two_route(planned).collect()][:4] == ["PRE", "PRE", "ACORN", "ACORN"]
    assert [r.plan for r in router.three_route(planned).collect()][4:] == ["PRE", "ACORN", "POST"]


def test_evaluation(spark):
    _, _, base, _, q = cloud(spark)
    got = {r.strategy: r for r in evaluate.evaluate(base, q, search.centroids(base), SearchOptions(k=5), 4).collect()}
    assert set(got) == {"PRE", "POST", "ACORN", "PLANNER"}
    assert all(r.recall == 1.0 and r.queries == 12 for r in got.values())
    p = got["PLANNER"]
    assert p.planner_pre + p.planner_post + p.planner_acorn == 12
