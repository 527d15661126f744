"""Rows joined to the ranges that hold them, on a segment tree over quantile stripes of the attribute.

The stripes are leaves of a binary tree. A range takes the fewest nodes that cover its stripes, a row the nodes above its own stripe, so that both meet once, on an equality; only in the range's outer
stripes can a row then be out of range, which the predicate itself settles. The tree ends ROOTS nodes below its top, so that no node holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.ranks import STRIPES, boundaries, latest, running, stripe
from nearfield.tables import written

#: Nodes of the topmost level, and levels from the stripes up to it.
ROOTS = 16
LEVELS = (STRIPES // ROOTS).bit_length()


def nodes_above(leaf: Column) -> Column:
    """The nodes, numbered from the top, in which a stripe lies."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: F.call_function("shiftright", leaf + STRIPES, level))


def cover(first: Column, last: Column) -> Column:
    """The fewest nodes that hold the stripes from first to last and no others: two a level at most, but ROOTS on the topmost; none if last is before first."""
    start = F.struct((first + STRIPES).alias("a"), (last + STRIPES + 1).alias("b"), F.array().cast("array<int>").alias("nodes"))
    none = F.array().cast("array<int>")

    def climb(s, _):
        """From a to before b, nodes of one level: an outer one whose sibling is out of the range is taken, the others go up to their parents."""
        left, right = s["a"] % 2 == 1, s["b"] % 2 == 1
        some = s["a"] < s["b"]
        nodes = F.concat(s["nodes"], F.when(some & left, F.array(s["a"])).otherwise(none), F.when(some & right, F.array(s["b"] - 1)).otherwise(none))
        a, b = F.shiftright(s["a"] + left.cast("int"), 1), F.shiftright(s["b"], 1)
        return F.struct(F.when(some, a).otherwise(s["b"]).alias("a"), F.when(some, b).otherwise(s["b"]).alias("b"), nodes.alias("nodes"))

    def topmost(s):
        return F.concat(s["nodes"], F.when(s["a"] < s["b"], F.sequence(s["a"], F.greatest(s["a"], s["b"] - 1))).otherwise(none))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 2)), start, climb, topmost)


def range_join(base: DataFrame, queries: DataFrame, attr: str = "attr") -> DataFrame:
    """base rows joined to the queries whose [lo, hi] holds their attribute: ranges of any width, with infinite ends, on any scale.

    Nulls, and ranges whose ends are in reverse, match nothing. A query is copied to LEVELS * 2 + ROOTS nodes at most, however wide its range; a row to LEVELS nodes, without a shuffle where Spark
    broadcasts the queries. Runs a job, for the stripes' boundaries. Queries with ends that differ in type from the attribute are compared as Spark compares them.
    """
    # one row of STRIPES - 1 numbers, as a constant of the plan
    bounds = F.split(F.lit(",".join(map(repr, boundaries(base, attr).first()[0]))), ",").cast("array<double>")
    asked = queries.where("lo <= hi").withColumn("_node", F.explode(cover(stripe(F.col("lo"), bounds), stripe(F.col("hi"), bounds))))
    rows = base.where(F.col(attr).isNotNull()).withColumn("_node", F.explode(nodes_above(stripe(F.col(attr), bounds))))
    return rows.join(asked, "_node").where(F.col(attr).between(F.col("lo"), F.col("hi"))).drop("_node")


def range_totals(base: DataFrame, queries: DataFrame, attr: str, of: str) -> DataFrame:
    """(query_id, n, least, most, total): what each query's [lo, hi] holds of base, how many rows, the smallest and largest attr and the sum of the whole number of; ranges that hold nothing are left out.

    Each value has the running totals up to it, and a range takes the difference of those at its last value and before its first one, so that work is linear in rows and queries, however many
    pairs of them there are. NaN takes no part, as a value or an end. Runs jobs.
    """
    v = F.col(attr)
    counts = base.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(v.alias("v")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(of), F.lit(0))).cast("long").alias("c"))
    sums = running(running(counts, "v", "n_upto", of="n"), "v", "c_upto", of="c")
    values = written(sums.select("v", (-F.col("v")).alias("down"), "n_upto", "c_upto", (F.col("n_upto") - F.col("n")).alias("n_below"), (F.col("c_upto") - F.col("c")).alias("c_below")), "totals")
    asked = queries.where("lo <= hi and not isnan(cast(hi as double))").select("query_id", "lo", "hi", (-F.col("lo")).alias("_down"))
    held = latest(asked, values, {"hi": "_to"}, "v")
    held = latest(held, values, {"_down": "_from"}, "down").where(F.col("_to.n_upto") > F.col("_from.n_below"))
    return held.select("query_id", (F.col("_to.n_upto") - F.col("_from.n_below")).alias("n"), F.col("_from.v").alias("least"), F.col("_to.v").alias("most"), (F.col("_to.c_upto") - F.col("_from.c_below")).alias("total"))
