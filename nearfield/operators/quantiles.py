"""Exact quantiles of groups by refinement: rounds of counts in stripes that go on only inside the stripes where a wanted rank lies, so that no task or aggregate holds all distinct values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.ranks import STRIPES, sketched, stripe
from nearfield.tables import remove, written

#: Rows of a stripe that are put in order as they are, and rounds at most: each leaves about a STRIPES-th of the rows before, so six are enough for any number.
LEAF, ROUNDS = 1 << 20, 6


def _inside(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """The values in each open interval of their group; intervals are at most two a share and group."""
    both = values.join(intervals, "_of")
    return both.where((F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") < F.col("_high"))))


def _wanted(start, count):
    return F.filter("_ranks", lambda r: (r >= start) & (r < start + count))


def _refined(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each interval's stripes that hold a wanted rank: (_of, _low, _high, _before, _n, _ranks, _value), _value where a stripe is one value, a boundary of the sketch."""
    inside = _inside(values, intervals.select("_of", "_at", "_low", "_high"))
    bounds = written(inside.groupBy("_of", "_at").agg(F.coalesce(sketched(F.col("_v")), F.array_repeat(F.lit(float("inf")), STRIPES - 1)).alias("_bounds")).join(intervals, ["_of", "_at"]), "quantile-bounds")
    dealt = _inside(values, bounds.select("_of", "_at", "_low", "_high", "_bounds")).withColumn("_s", stripe(F.col("_v")))
    counts = dealt.groupBy("_of", "_at", "_s", F.coalesce(F.get("_bounds", F.col("_s") - 1) == F.col("_v"), F.lit(False)).alias("_one")).agg(F.count("*").alias("_c"), F.min("_v").alias("_value"))
    # at most 2 * STRIPES rows an interval; a boundary comes before the values between it and the next
    before = F.sum("_c").over(Window.partitionBy("_of", "_at").orderBy("_s", F.col("_one").desc()).rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("_start", F.coalesce(before, F.lit(0).cast("long"))).join(bounds, ["_of", "_at"]).withColumn("_start", F.col("_start") + F.col("_before"))
    kept = placed.withColumn("_ranks", _wanted(F.col("_start"), F.col("_c"))).where(F.size("_ranks") > 0)
    low, high = F.coalesce(F.get("_bounds", F.col("_s") - 1), "_low"), F.coalesce(F.get("_bounds", F.col("_s")), "_high")
    out = kept.select("_of", low.alias("_low"), high.alias("_high"), F.col("_start").alias("_before"), F.col("_c").alias("_n"), "_ranks", F.when(F.col("_one"), F.col("_value")).alias("_value"))
    out = written(out.withColumn("_at", F.monotonically_increasing_id()), "quantile-stripes")
    remove(bounds)
    return out


def quantiles(rows: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = (), leaf: int = LEAF) -> DataFrame:
    """(*by, n, q): the number of values of each group, and their quantiles at the shares as an array of doubles, linear between the two nearest ranks.

    Null values are left out, and groups of nulls alone with them; NaN stands above all numbers. Null is a group of its own. Runs a job to count groups, and two for
    each round, of which there are none where no group has more rows than leaf. rows is read once more in each: pass a table where it is dear to make.
    """
    of = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    values = rows.select(of.alias("_of"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    places = [(F.col("n") - 1) * F.lit(float(p)) for p in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in places])))
    totals = written(values.groupBy("_of").agg(F.count("*").alias("n")).withColumn("_ranks", ranks), "quantile-groups")
    none = F.lit(None).cast("double")
    intervals = totals.select("_of", none.alias("_low"), none.alias("_high"), F.lit(0).cast("long").alias("_before"), F.col("n").alias("_n"), "_ranks", none.alias("_value"), F.monotonically_increasing_id().alias("_at"))
    found = []
    for _ in range(ROUNDS):
        if (intervals.agg(F.max("_n")).first()[0] or 0) <= leaf:
            break
        stripes = _refined(values, intervals.drop("_n", "_value"))
        found.append(stripes.where("_value is not null").select("_of", "_ranks", "_value"))
        intervals = stripes.where("_value is null")
    counts = _inside(values, intervals.drop("_value", "_n")).groupBy("_of", "_at", "_v").agg(F.count("*").alias("_c"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"))
    before = F.sum("_c").over(Window.partitionBy("_of", "_at").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_start", F.coalesce(before, F.lit(0).cast("long")) + F.col("_before"))
    found.append(counts.select("_of", _wanted(F.col("_start"), F.col("_c")).alias("_ranks"), F.col("_v").alias("_value")).where(F.size("_ranks") > 0))
    each = reduce(DataFrame.unionByName, found).select("_of", F.explode("_ranks").alias("_r"), "_value")
    at = each.groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_value"))).alias("_at"))
    q = []
    for x in places:
        a, b = F.col("_at")[F.floor(x)], F.col("_at")[F.ceil(x)]
        q.append(F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b))
    return totals.join(at, "_of").select(*[F.col("_of")[c].alias(c) for c in by], "n", F.array(*q).alias("q"))
