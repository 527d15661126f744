import random

from pyspark.sql import functions as F

from nearfield.operators import stats, workload
from nearfield.operators.ranks import counted_up_to, running


def test_running_and_counts_against_plain_loops(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0.0, -3.5, 7.25, rnd.uniform(-1e6, 1e6), rnd.uniform(0, 1)]), rnd.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double, n long")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r.id: r.place for r in running(df, "v", "place", ("id",)).collect()} == {r[0]: k + 1 for k, r in enumerate(order)}
    sums, total = {}, 0
    for i, _, n in order:
        total += n
        sums[i] = total
    assert {r.id: r.total for r in running(df, "v", "total", ("id",), of="n").collect()} == sums
    points = [(k, x) for k, x in enumerate([None, -1e9, 1e9, 0.0, -3.5, 7.25, float("inf"), *[r[1] for r in rows[:40]], *[rnd.uniform(-1e6, 1e6) for _ in range(40)]])]
    p = spark.createDataFrame(points, "_p long, x double")
    for inclusive in (True, False):
        got = {r["_p"]: r.below for r in counted_up_to(p, df.select("v", "n"), "x", "below", inclusive).collect()}
        assert got == {k: 0 if x is None else sum(n for _, v, n in rows if v < x or inclusive and v == x) for k, x in points}


def test_one_value_and_nothing(spark):
    one = spark.createDataFrame([(1, 4), (2, 4), (3, None)], "vec_id long, attr long")
    q = spark.createDataFrame([(0, 4, 4), (1, 5, 9), (2, 0, 3), (3, 9, 1), (4, None, 9), (5, 0, 9)], "query_id long, lo long, hi long")
    got = {r.query_id: (r.m, round(r.selectivity, 6)) for r in stats.selectivity(one, q).collect()}
    assert got == {0: (2, 0.666667), 1: (0, 0.0), 2: (0, 0.0), 3: (0, 0.0), 4: (0, 0.0), 5: (2, 0.666667)}
    assert {r.m for r in stats.selectivity(one.where("false"), q).collect()} == {0}
    assert running(one.where("false"), "attr", "place").count() == 0


def test_drawn_queries(spark):
    pool = spark.createDataFrame([(i * 3, [float(i)]) for i in range(20)], "query_id long, qvec array<double>")
    few, many = workload.drawn_queries(pool, 7).collect(), workload.drawn_queries(pool, 50).collect()
    assert sorted(r.query_id for r in few) == list(range(7)) and len({r.source_id for r in few}) == 7
    assert sorted(r.query_id for r in many) == list(range(50)) and all(r.qvec == [r.source_id / 3] for r in few + many)
    wanted = [r.target_selectivity for r in workload.uniform_selectivities(pool).collect()]
    assert all(1e-4 <= s <= 0.4 for s in wanted) and len(set(wanted)) > 15
    assert stats.realised(workload.uniform_selectivities(pool), "target_selectivity").first().least == min(wanted)
    assert pool.where(F.col("query_id") < 0).count() == 0
