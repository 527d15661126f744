import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators.quantiles import quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]


def groups():
    rng = np.random.default_rng(5)
    return {
        "even": rng.normal(size=6000),
        "far": np.concatenate([rng.random(4000), [1e15, -1e15]]),
        "heavy": np.concatenate([np.full(5000, 3.5), rng.random(300) * 7]),
        "two": np.array([1.0, 2.0] * 2500),
        "one": np.array([4.25]),
        "same": np.full(3000, -2.0),
        None: rng.integers(0, 50, 2000).astype(float),
    }


@pytest.mark.parametrize("leaf", [1 << 20, 500, 2])
def test_against_numpy(spark, leaf):
    """With small leaves the rounds run, down to stripes of single values."""
    rows = [(g, float(v)) for g, x in groups().items() for v in x] + [("even", None), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in quantiles(df, "v", SHARES, ("g",), leaf).collect()}
    assert set(got) == set(groups())
    for g, x in groups().items():
        assert got[g].n == len(x)
        assert np.allclose(got[g].q, np.quantile(x, SHARES), rtol=1e-12, atol=1e-12), g


def test_whole_tables_and_empty_ones(spark):
    df = spark.range(100_001).select((F.col("id") * 3).alias("v"))
    assert quantiles(df, "v", [0.5, 0.25], leaf=100).first().q == [150_000.0, 75_000.0]
    assert quantiles(df.limit(0), "v", [0.5]).collect() == []
    extra = spark.createDataFrame([(1, 2.0, "x")], "_v int, v double, _of string")
    assert quantiles(extra, "v", [0.5], ("_of",)).first()["q"] == [2.0]


def test_infinite_values(spark):
    x = [float("-inf")] * 30 + [float(i) for i in range(40)] + [float("inf")] * 31
    q = quantiles(spark.createDataFrame([(v,) for v in x], "v double"), "v", [0.0, 0.5, 1.0], leaf=10).first().q
    assert q == [float("-inf"), 20.0, float("inf")]
