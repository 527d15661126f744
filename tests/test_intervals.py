import math
import random

import pytest
from pyspark.sql import functions as F

from nearfield.operators import intervals, ranks, search, stats, workload

INF = float("inf")


def joined(spark, values, asked, kind="double"):
    base = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"vec_id long, attr {kind}")
    q = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(asked)], "query_id long, lo double, hi double")
    got = [(r.query_id, r.vec_id) for r in intervals.range_join(base, q).select("query_id", "vec_id").collect()]
    assert len(got) == len(set(got))
    want = {(q, i) for q, (lo, hi) in enumerate(asked) for i, v in enumerate(values) if None not in (v, lo, hi) and lo <= v <= hi}
    assert set(got) == want
    return base, q


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e12, 1e300])
def test_ranges_of_any_width_on_any_scale(spark, scale):
    rnd = random.Random(2)
    values = [rnd.random() * scale for _ in range(1500)] + [0.25 * scale] * 300 + [None, -INF, INF, -5 * scale, 1e15]
    asked = [(-INF, INF), (0.0, scale), (0.25 * scale, 0.25 * scale), (-1e11, 1e11), (-INF, 0.5 * scale), (0.75 * scale, INF), (0.9 * scale, 0.1 * scale), (None, scale), (0.0, None), (7 * scale, 8 * scale)]
    asked += [tuple(sorted((rnd.random() * scale, rnd.random() * scale))) for _ in range(30)]
    asked += [(x, x + scale / 1e4) for x in (rnd.random() * scale for _ in range(10))]
    joined(spark, values, asked)


def test_cover_holds_every_stripe_once(spark):
    n = intervals.STRIPES
    rnd = random.Random(3)
    pairs = [(0, n - 1), (0, 0), (n - 1, n - 1), (1, n - 2), (5, 4), (n - 1, 0), *[tuple(sorted(rnd.sample(range(n), 2))) for _ in range(60)]]
    df = spark.createDataFrame(pairs, "a int, b int")
    got = df.select("a", "b", intervals.cover(F.col("a"), F.col("b")).alias("nodes")).collect()
    above = {r.s: set(r.nodes) for r in spark.range(n).selectExpr("cast(id as int) as s").select("s", intervals.nodes_above(F.col("s")).alias("nodes")).collect()}
    for r in got:
        assert len(r.nodes) == len(set(r.nodes)) <= 2 * intervals.LEVELS + intervals.ROOTS
        for s in range(n):
            assert len(above[s] & set(r.nodes)) == (r.a <= s <= r.b)


def test_few_copies_of_a_query(spark):
    """No query is copied more than twice the logarithm of the rows."""
    base = spark.range(10_000).select(F.col("id").alias("vec_id"), F.col("id").cast("double").alias("attr"))
    bounds = F.broadcast(ranks.boundaries(base, "attr"))
    q = spark.createDataFrame([(float(a), float(b)) for a, b in ((1, 9998), (-1e30, 1e30), (77, 8765), (4999, 5001))], "lo double, hi double").crossJoin(bounds)
    most = q.select(F.max(F.size(intervals.cover(ranks.stripe(F.col("lo")), ranks.stripe(F.col("hi")))))).first()[0]
    assert most <= 2 * math.log2(10_000)


def test_one_outlier_leaves_the_stripes_spread(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") == 0, 1e15).otherwise(F.col("id") / 7.0).alias("v"))
    spread = rows.crossJoin(F.broadcast(ranks.boundaries(rows, "v"))).groupBy(ranks.stripe(F.col("v"))).count()
    n, most = spread.agg(F.count("*"), F.max("count")).first()
    assert n >= 512 and most <= 1000


def test_values_that_fill_stripes_are_split(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") % 11 * 1.0).alias("v"))
    got = ranks.running(rows, "v", "r", ("id",), split_ties=True).collect()
    want = {x: k + 1 for k, (_, x) in enumerate(sorted((r.v, r.id) for r in got))}
    assert all(want[r.id] == r.r for r in got) and len(got) == 20_000
    dealt = ranks._dealt(rows, "v", "id").where("v = 5").groupBy("_s", "_t").count().agg(F.count("*"), F.max("count")).first()
    assert dealt[0] >= 512 and dealt[1] <= 100


def test_as_of(spark):
    rnd = random.Random(4)
    values = [(float(v), f"n{v}") for v in rnd.sample(range(-500, 5000), 700)]
    points = [(k, rnd.choice([rnd.uniform(-700, 6000), rnd.choice(values)[0]])) for k in range(400)] + [(1000, None), (1001, INF), (1002, -INF)]
    got = {r.id: r.name for r in ranks.latest(spark.createDataFrame(points, "id long, x double"), spark.createDataFrame(values, "at double, name string"), {"x": "row"}, "at").select("id", "row.name").collect()}
    want = {}
    for k, x in points:
        before = [(v, n) for v, n in values if x is not None and v <= x]
        if before:
            want[k] = max(before)[1]
    assert got == want


def test_large_integers_are_counted_exactly(spark):
    big = 2**60
    base = spark.createDataFrame([(i, big + i) for i in range(50)], "vec_id long, attr long")
    q = spark.createDataFrame([(0, big + 3, big + 7), (1, big + 49, big + 90)], "query_id long, lo long, hi long")
    assert {r.query_id: r.m for r in stats.selectivity(base, q).collect()} == {0: 5, 1: 1}
    pos = workload.positions(base)
    at = spark.createDataFrame([(0, 49), (1, 0), (2, 50)], "query_id long, at long")
    assert {r.query_id: r.v for r in workload.value_at(at, pos, "at", "v").collect()} == {0: big + 49, 1: big}


def test_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_BYTES", 2000)
    base = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "vec_id long, vec array<double>")
    q = spark.createDataFrame([(i, [float(i) + 0.1]) for i in range(100)], "query_id long, qvec array<double>")
    pairs = search.all_pairs(base, q)
    assert pairs.select("query_id", "vec_id").distinct().count() == pairs.count() == 4000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_truth_of_hot_ranges(spark, monkeypatch):
    monkeypatch.setattr(search, "RANGE_QUERIES", 7)
    rnd = random.Random(6)
    base = spark.createDataFrame([(i, [rnd.random(), rnd.random()], rnd.randrange(100)) for i in range(200)], "vec_id long, vec array<double>, attr long")
    q = spark.createDataFrame([(i, [rnd.random(), rnd.random()], *((10, 60) if i % 3 else (i, i + 20))) for i in range(60)], "query_id long, qvec array<double>, lo long, hi long")
    assert sorted(search.ground_truth(base, q, 4).collect()) == sorted(search.pre_filter(base, q, 4).collect())


def test_totals_of_ranges(spark):
    rows = [(i, float(v)) for i, v in enumerate([3, 3, -5, 0, 8, 8, 8, 2.5, -5, 100])] + [(50, None)]
    base = spark.createDataFrame(rows, "key long, attr double")
    inf = float("inf")
    asked = [(1, -inf, inf), (2, 3.0, 8.0), (3, 3.1, 7.9), (4, 8.0, 3.0), (5, -inf, -5.0), (6, 100.0, inf), (7, 101.0, inf), (8, -6.0, 2.5), (9, None, 3.0), (10, 3.0, 3.0)]
    got = sorted(tuple(r) for r in intervals.range_totals(base, spark.createDataFrame(asked, "query_id long, lo double, hi double"), "attr", "key").collect())
    want = []
    for q, lo, hi in asked:
        held = [(k, v) for k, v in rows if v is not None and lo is not None and lo <= v <= hi]
        if held:
            want.append((q, len(held), min(v for _, v in held), max(v for _, v in held), sum(k for k, _ in held)))
    assert got == want
