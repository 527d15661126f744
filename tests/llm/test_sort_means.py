import hashlib
import random

import duckdb
import numpy as np
import pytest

from nearfield.llm.oracles import SORT_MEANS
from nearfield.llm.sort_means import LONG, Centroids, sort_means

from .fixtures import SF


def brute(rows, k, rounds, width, scale=1024):
    """Plain k-means in Python's whole numbers."""
    good = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in good if i is not None)[:k]
    centres = [v for _, _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in good]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(good, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in good]
    inertia = [sum(d for _, c, d in out if c == j) for j in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, min(d, LONG), min(inertia[c], LONG), min(sum(inertia), LONG), digest[c]) for i, c, d in out), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'x' as cluster", "1 as v", "2 as distance", "3 as dim", "4 as total", "5 as inertia")


def test_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(SORT_MEANS)
    names = [d[0] for d in want.description]
    got = sort_means(spark.read.parquet(f"{SF}/embeddings.parquet")).select(*names)
    assert result(got) == sorted(want.fetchall(), key=str)


def test_clusters_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, 3.0]) + (i % 3), rng.choice([0.0, 0.25, -0.125]), float(i % 2)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (7, rows[7][1])]
    assert result(sort_means(table(spark, rows), k=5, rounds=4, width=3)) == brute(rows, 5, 4, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [i % 5 + 0.1, -(i % 7) - 0.2]) for i in range(40)]
    rows += [(50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [nan, 1.0]), (55, [inf, 0.0]), (56, [1.0, 2.0, 3.0]), (None, [0.5, 0.5]), (None, [90.0, 90.0])]
    assert result(sort_means(table(spark, rows), k=4, rounds=10, width=2)) == brute(rows, 4, 10, 2)


def test_components_of_any_size(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 6, 9, 20, 37]), rng.uniform(-1, 1) * 1e3]) for i in range(60)]
    assert result(sort_means(table(spark, rows), k=4, rounds=3, width=2)) == brute(rows, 4, 3, 2)


def test_few_rows_and_none(spark):
    assert sort_means(table(spark, []), width=2).collect() == []
    assert sort_means(table(spark, [(None, [1.0, 2.0])]), width=2).collect() == []
    few = [(3, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [5.0, 0.0])]
    assert result(sort_means(table(spark, few), width=2)) == brute(few, 8, 10, 2)


@pytest.mark.parametrize("scale", [10, 2**30])
def test_scan_stops_early_and_loses_nothing(scale):
    rng = np.random.default_rng(1)
    at = (rng.normal(size=(12, 4)) * scale).astype(np.int64)
    centroids = Centroids(at.tolist())
    v = (at[rng.integers(0, 12, 300)] + rng.normal(size=(300, 4)) * scale / 50).astype(np.int64).astype(np.float64)
    looked, plain = [], centroids.squared
    centroids.squared = lambda rows, c: looked.append(len(rows)) or plain(rows, c)
    own, best = centroids.nearest(v, rng.integers(0, 12, 300))
    want = [min((sum((int(a) - b) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(at.tolist())) for row in v]
    assert [(int(d), int(j)) for d, j in zip(best, own, strict=True)] == want
    looked.clear()
    centroids.nearest(v, own)
    assert sum(looked) < 300 * 12 / 2
