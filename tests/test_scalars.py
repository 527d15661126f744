import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import scalars
from nearfield.operators import calibrate, catalog, workload


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,value", [("₹1,299.00", 1299.0), ("", None), ("1.2.3", None), ("-5", -5.0), (None, None)])
def test_price(spark, text, value):
    assert one(spark, text, scalars.price) == value


@pytest.mark.parametrize("text,value", [("4.5 out of 5", 4.5), ("n/a", None), (None, None)])
def test_rating(spark, text, value):
    assert one(spark, text, scalars.rating) == value


@pytest.mark.parametrize("text,value", [("Home > Kitchen", "Home"), ("A|B", "A"), ("  ", None), (">", ">"), ("Home, Kitchen", "Home"), (None, None)])
def test_category(spark, text, value):
    assert one(spark, text, scalars.top_category) == value


@pytest.mark.parametrize("s,t", [(0.001, 0.007354), (0.0001, 0.007354), (0.5, 0.006374), (1.0, 0.006374), (math.sqrt(0.001 * 0.01), (0.007354 + 0.028364) / 2), (0.0, None), (1.5, None)])
def test_tau(spark, s, t):
    got = one(spark, s, lambda c: scalars.tau(c, "tanh"), "double")
    assert got == (None if t is None else pytest.approx(t))


def test_tokens(spark):
    assert one(spark, 0.01, scalars.selectivity_token, "double") == "0p01"
    assert one(spark, "tau_0p001_summary.csv", scalars.selectivity_of_name) == 0.001


def test_split():
    assert workload.split_evenly(10, 3) == [4, 3, 3]


def test_log_binomial(spark):
    for n, k in ((5, 2), (30, 7), (2000, 100), (9, 9), (12, 0)):
        got = spark.range(1).select(calibrate.log_binomial(F.lit(n), F.lit(k)).alias("v")).first().v
        assert got == pytest.approx(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1), abs=1e-9)


def test_clean(spark):
    raw = spark.createDataFrame([("Pan", "Steel", "Home > Kitchen", "$5", "4 of 5"), ("nan", "x", "", "", ""), ("Cup", None, None, None, None)], "Name string, details string, Main_Category string, List_Price string, stars string")
    got = catalog.clean(raw).collect()
    assert [(r.title, r.category, r.price, r.rating, r.text_for_embedding) for r in got] == [("Pan", "Home", 5.0, 4.0, "Pan. Steel"), ("Cup", None, None, None, "Cup")]
    with pytest.raises(ValueError):
        catalog.clean(raw.select("stars"))


def test_fit_meets_its_points(spark):
    points = spark.createDataFrame([(0.001, 0.1), (0.01, 0.3), (0.1, 0.2)], "selectivity double, tau double")
    got = calibrate.interpolated(points.select("selectivity"), calibrate.fit_tau(points, 5)).collect()
    assert [r.interpolated_tau for r in got] == pytest.approx([0.1, 0.3, 0.2])


def test_spaced_numbers_and_json(spark):
    one = spark.range(1)
    for kind, args in (("linspace", (0.0, 3.0, 7)), ("logspace", (-3.0, 0.0, 4)), ("geomspace", (0.001, 0.5, 9)), ("linspace", (2.0, 9.0, 1))):
        assert np.allclose(one.select(scalars.spaced(kind, *args).alias("x")).first().x, getattr(np, kind)(*args))
    for args in ((0.0, 1.0, 0.3), (5.0, 5.0, 1.0), (1.0, 4.0, 1.0)):
        assert np.allclose(one.select(scalars.stepped(*args).alias("x")).first().x, np.arange(*args))
    rows = spark.createDataFrame([('{"b": "x", "a": 3}',), ("{",), (None,)], "j string").select(scalars.parsed_json(F.col("j"), "a long, b string").alias("o")).select("o.*").collect()
    assert [tuple(r) for r in rows] == [(3, "x"), (None, None), (None, None)]
