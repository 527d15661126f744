import numpy as np
from pyspark.sql import functions as F

from nearfield.llm.knn_join import _Groups, integer_vectors, knn_join

from .fixtures import SF


def brute(rows, k, step):
    good = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in good if i % step == 0}.items():
        best = sorted((-int(v @ w), i) for i, w in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_as_brute_force(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert result(knn_join(v, F.col("vec_id") % 50 == 0)) == brute([(r.vec_id, r.embedding) for r in v.collect()], 5, 50)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    rows += [(40, None), (41, [1.0, None, 0.0]), (50, [float("nan"), 0.0, 0.0]), (43, [float("inf"), 0.0, 0.0]), (44, []), (None, [1.0, 1.0, 1.0])]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(45, 49)] + [(100, [0.5, 0.5, 0.5]), (47, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as g", "'x' as block", "2 as v")
    got = result(knn_join(df, F.col("vec_id") % 10 == 0))
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(rows32, 5, 10)


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert knn_join(one, F.col("vec_id") % 50 == 0).collect() == []
    assert knn_join(one.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1e5, 3.0])], "vec_id long, embedding array<double>")
    assert result(knn_join(three, F.col("vec_id") == 0)) == [(0, 1, 2, 25600000 * 256), (0, 2, 1, 512 * 256)]


def test_large_components_are_exact(spark):
    rows = [(i, [float((i * 7919) % 8_000_000 + j) for j in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(knn_join(df, F.col("vec_id") % 50 == 0)) == brute(rows, 5, 50)


def test_bounds_prune_and_hold():
    """Groups far away are left out, and no bound cuts a true neighbour."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8)) * 500
    data = np.vstack([c + rng.normal(size=(50, 8)) * 5 for c in centres]).astype(np.int64)
    g = _Groups(centres)
    own, dist = g.assign(data)
    g.radius = np.array([dist[own == i].max() for i in range(6)])
    g.norm = np.array([np.linalg.norm(data[own == i], axis=1).max() for i in range(6)])
    g.near = np.array([np.sort(dist[own == i])[:6] for i in range(6)])
    q = data[::50]
    wanted = g.most(q) >= g.least(q, 5)[:, None]
    assert wanted.sum() < wanted.size / 2
    scores = q @ data.T
    for i in range(len(q)):
        for j in np.argsort(-scores[i])[:6]:
            assert wanted[i, own[j]]


def test_scaled_floor(spark):
    df = spark.createDataFrame([(1, [-0.001, 0.999, 0.5])], "vec_id long, embedding array<float>")
    assert integer_vectors(df).first().v == [-1, 255, 128]


def exact(rows, k, step):
    """Brute force in whole numbers of any size, zeros after shorter vectors, scores as longs."""
    most = max(len(v) for _, v in rows)
    good = [(i, [int(np.floor(x * 256)) if abs(x) < 2**40 else int(x * 256) for x in v] + [0] * (most - len(v))) for i, v in rows]
    out = []
    for q, v in good:
        if q % step == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:k]
            out += [(q, r + 1, i, max(min(-s, 2**63 - 1), 1 - 2**63)) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_no_finite_vector_is_left_out(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 1.0]), (1, [1e8, 1.0]), (2, [1.0, 2.0]), (3, [1e30, -1e30]), (4, [3e37, 1.0]), (5, [-3e37, 2.0]), (6, [1e200, 0.5]), (7, [1e30, 1e10]), (8, [1e30, 2e10])]
    rows += [(i, [float(x) for x in rng.normal(size=2) * 10.0 ** rng.integers(0, 25)]) for i in range(9, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(knn_join(df, F.col("vec_id") % 5 == 0)) == exact(rows, 5, 5)


def test_shorter_vectors_end_in_zeros(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=1 + i % 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(knn_join(df, F.col("vec_id") % 6 == 0)) == exact(rows, 5, 6)


def test_clusters_far_away_are_not_searched(spark):
    """End to end: queries go only to groups near them, and the result is the brute-force one."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 6)) * 100
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=6)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn_join(df, F.col("vec_id") % 50 == 0)
    assert result(got) == brute(rows, 5, 50)
    assert got.routes.count() <= 24  # of 64 pairs of a block and a group
