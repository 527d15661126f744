import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import jobs
from nearfield.operators import models, search
from nearfield.operators.search import SearchOptions
from nearfield.plans import experiments
from nearfield.plans.states import State


@pytest.fixture(scope="module")
def backend(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 3)) + np.repeat(np.arange(3), 50)[:, None] * 5
    rows = [(i, v.tolist(), int(rng.integers(0, 100)), i // 50) for i, v in enumerate(x)]
    base = spark.createDataFrame(rows, "vec_id long, vec array<double>, attr long, cluster_id int").cache()
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[::10] + 0.1)], "query_id long, qvec array<double>")
    return State(base, search.centroids(base).cache()), pool, x, np.array([r[2] for r in rows])


def test_null_experiment(spark, backend, tmp_path):
    state, pool, x, attr = backend
    run = experiments.null_experiment(state, pool, [0.2, 0.5], n=8, k=4, subsets=4, every=3)
    run.scores.write.parquet(str(tmp_path / "s"))
    run = experiments.null_tables(spark.read.parquet(str(tmp_path / "s")), every=3)
    s = run.scores.toPandas()
    assert len(s) == 16 and sorted(s.query_id[s.selectivity == 0.2]) == list(range(8))
    for r in s.itertuples():
        inside = (attr >= r.range_lo) & (attr <= r.range_hi)
        assert r.subset_size == inside.sum() and r.k_used == min(4, inside.sum()) and abs(r.actual_selectivity - inside.mean()) < 1e-9
        assert r.abs_tanh_correlation == abs(r.tanh_correlation) and r.monte_carlo_samples == 4
        assert abs(r.true_correlation - (r.expected_random_gk - r.admissible_gk) / r.expected_random_gk) < 1e-9
    for r in run.summary.collect():
        part = s[s.selectivity == r.selectivity]
        assert (r.queries, r.actual_least, r.actual_most) == (8, part.actual_selectivity.min(), part.actual_selectivity.max())
        for m, c in experiments.METRICS.items():
            assert abs(r[f"{m}_tau_q99"] - np.quantile(part[f"abs_{c}"], 0.99)) < 1e-9
    history = {(r.selectivity, r.processed): r.pgap for r in run.history.collect()}
    assert set(history) == {(a, b) for a in (0.2, 0.5) for b in (3, 6, 8)}
    for (sel, upto), got in history.items():
        assert abs(got - np.quantile(s.abs_pgap_correlation[(s.selectivity == sel) & (s.query_id < upto)], 0.99)) < 1e-9
    top = run.largest.where("selectivity = 0.5 and metric = 'true_correlation'").orderBy("rank").toPandas()
    assert list(top["size"]) == sorted(s.abs_true_correlation[s.selectivity == 0.5], reverse=True)


def test_selectivities():
    assert experiments.parse_selectivities(" 0.5, 0.01,,1 ") == [0.01, 0.5, 1.0]
    for bad in ("", "0", "0.1,1.5", "x"):
        with pytest.raises(ValueError):
            experiments.parse_selectivities(bad)


def test_comparison_and_classification(spark, backend):
    state, pool, _, _ = backend
    q = pool.where("query_id < 4").withColumn("lo", F.col("query_id") * 10).withColumn("hi", F.col("query_id") * 10 + 40)
    both = {"corr": state, "rand": state}
    compared = experiments.correlation_comparison(both, {"positive": q, "negative": q.withColumn("hi", F.col("hi") + 5), "random": q}, 5).cache()
    assert compared.count() == 12 and len(compared.columns) == 14
    rows, tables = compared.toPandas(), experiments.classification(compared, 0.1).toPandas()
    limit = {"true": 0.045303, "heuristic": 0.104385, "tanh": 0.026088, "pgap": 0.004521}
    of = lambda v, t: "positive" if v > t else "negative" if v < -t else "random"
    assert len(tables) == 9
    for r in tables.itertuples():
        guess = [of(v, limit[r.metric]) for v in rows[experiments.METRICS[r.metric]]]
        real = [of(v, limit["true"]) for v in rows.true_correlation]
        assert [r.negative, r.random, r.positive] == [sum(a == r.actual_class and g == c for a, g in zip(real, guess, strict=True)) for c in experiments.CLASSES]
        assert abs(r.metric_accuracy - np.mean([a == g for a, g in zip(real, guess, strict=True)])) < 1e-9


def test_strategy_report(backend):
    state, pool, _, _ = backend
    q = pool.where("query_id < 5").withColumn("lo", F.lit(20).cast("long")).withColumn("hi", F.lit(70).cast("long"))
    got = {r.strategy: r for r in experiments.strategy_report(state, q, SearchOptions(k=3), 3).collect()}
    assert set(got) == {"PRE", "POST", "ACORN", "PLANNER"} and all(r.recall_at_k == 1.0 for r in got.values())
    p = got["PLANNER"]
    assert p.pre_queries + p.post_queries + p.acorn_queries == 5 == p.corr_positive + p.corr_random + p.corr_negative and got["PRE"].routing_time_s is None


def test_jobs(spark, tmp_path):
    head = "correlation_type,true_correlation,heuristic_correlation,tanh_correlation,pgap_correlation"
    (tmp_path / "c.csv").write_text("\n".join([head, *[f"{c},{v},{v},{v},{v}" for c, v in (("Positive", 0.9), ("Negative", -0.8), ("Random", 0.1), ("Random", -0.2))]]))
    jobs.main(["estimate", "--input", str(tmp_path / "c.csv"), "--out", str(tmp_path / "e"), "--metric", "tanh", "--num-points", "10"])
    best = spark.read.csv(str(tmp_path / "e" / "best"), header=True).first()
    assert float(best.balanced_accuracy) == 1.0 and 0.2 <= float(best.tau) < 0.8
    for token, t in (("0p001", 0.1), ("0p01", 0.2), ("0p1", 0.3)):
        (tmp_path / f"x_{token}_summary.csv").write_text(f"metric,tau,accuracy,balanced_accuracy,macro_f1\ntanh,{t},1,1,1\n")
    jobs.main(["interpolate", "--root", str(tmp_path), "--out", str(tmp_path / "i"), "--degree", "1", "--grid", "0.01,1"])
    curve = {float(r.selectivity): float(r.interpolated_tau) for r in spark.read.csv(str(tmp_path / "i" / "curve"), header=True).collect()}
    assert abs(curve[0.01] - 0.2) < 1e-9 and abs(curve[1.0] - 0.4) < 1e-9


def hashed(x, salt):
    h = (x + salt * 7919) % 2**31
    for shift in (16, 15):
        h = ((h ^ (h >> shift)) * 73244475) % 2**31
    return (h ^ (h >> 16)) + 0.5


def test_models_against_numpy(spark, backend):
    state, _, x, _ = backend
    vectors = state.base.select("vec_id", "vec")
    own, centres = models.kmeans_cells(vectors, 3)
    c = np.array([r.centroid for r in centres.orderBy("cluster_id").collect()])
    d = np.linalg.norm(x[:, None] - c[None], axis=2)
    label = {r.vec_id: r.cluster_id for r in own.select("vec_id", "cluster_id").collect()}
    assert [label[i] for i in range(len(x))] == d.argmin(1).tolist()
    assert all(np.allclose(c[j], x[[i for i in label if label[i] == j]].mean(0)) for j in range(3))
    got = np.array([[r.c1, r.c2] for r in models.principal_components(vectors, 2).orderBy("vec_id").collect()])
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ v[:2].T), atol=1e-6)
    second = np.sort(np.linalg.norm(x[:, None] - c[None], axis=2), axis=1)[:, 1]
    assert abs(models.local_sigma(vectors, centres) - np.median(second)) < 1e-9
    anchors = [r.anchor for r in models.smoothed_anchors(centres).orderBy("cluster_id").collect()]
    start = np.array([hashed(j, 12) / 2**31 for j in range(3)])
    a, gaps = start.copy(), [min(np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)]
    w = [[1.0 if i == j else np.exp(-np.linalg.norm(c[i] - c[j]) ** 2 / (2 * np.median(gaps) ** 2)) for j in range(3)] for i in range(3)]
    for _ in range(12):
        a = np.array([0.8 * sum(w[i][j] * a[j] for j in range(3)) / sum(w[i]) + 0.2 * start[i] for i in range(3)])
    assert np.allclose(anchors, (a - a.min()) / (a.max() - a.min()))


def test_options_and_empty_clusters(spark, backend):
    state, pool, _, _ = backend
    for bad in ({"k": 0}, {"fetch_mult": 0}, {"max_retries": -1}, {"max_fetch_k": 0}):
        with pytest.raises(ValueError):
            SearchOptions(**bad)
    wanted = spark.createDataFrame([(0,), (9,)], "cluster_id int")
    got = {r.cluster_id: r.centroid for r in search.centroids(state.base, clusters=wanted).collect()}
    assert set(got) == {0, 9} and got[9] == [0.0] * 3 and any(got[0])
    assert search.first_queries(pool, 3).count() == 3


def test_compare_job(spark, backend, tmp_path):
    state, pool, _, _ = backend
    state.base.select("vec_id", "vec").write.parquet(str(tmp_path / "v"))
    pool.select("query_id", "qvec").write.parquet(str(tmp_path / "q"))
    jobs.main(["compare", "--vectors", str(tmp_path / "v"), "--queries", str(tmp_path / "q"), "--out", str(tmp_path / "o"), "--sel", "0.2", "--n-queries", "4", "--neighbours", "5", "--k-eval", "3"])
    compared = spark.read.csv(str(tmp_path / "o" / "comparison"), header=True)
    assert {r.correlation_type: r["count"] for r in compared.groupBy("correlation_type").count().collect()} == {"positive": 4, "negative": 4, "random": 4}
    matrix = spark.read.csv(str(tmp_path / "o" / "matrix_tanh"), header=True).collect()
    assert sum(int(r.negative) + int(r.random) + int(r.positive) for r in matrix) == 12
