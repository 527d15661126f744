"""Places in an order, counts up to a value and values at a place, in two levels: stripes whose boundaries are quantiles of the data, then rows inside a stripe.

No window over all rows and no inequality join. Boundaries come from a mergeable sketch, so that stripes hold about equally many rows however the values lie; they are one row of STRIPES - 1 numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.tables import written

#: Stripes of an order, a power of two, and the sketch's accuracy (a stripe's share of rows is right to one part in ACCURACY).
STRIPES, ACCURACY = 1024, 10_000


def _number(c: Column) -> Column:
    return c.cast("double")


def sketched(c: Column) -> Column:
    """STRIPES - 1 boundaries of a column's finite values."""
    inside = F.when(~F.isnan(_number(c)) & (F.abs(_number(c)) != float("inf")), _number(c))
    return F.percentile_approx(inside, [i / STRIPES for i in range(1, STRIPES)], ACCURACY)


def boundaries(rows: DataFrame, by: str) -> DataFrame:
    """One row (_bounds): the values at which stripes of the number by begin, but the first; a value that many rows have is there several times. Infinities, NaN and null count as none."""
    return rows.agg(F.coalesce(sketched(F.col(by)), F.array_repeat(F.lit(float("inf")), STRIPES - 1)).alias("_bounds"))


def stripe(v: Column, bounds: Column | str = "_bounds") -> Column:
    """How many boundaries are not above v, by binary search: larger values never have a smaller stripe. Null and NaN are in the last."""
    at, x = F.col(bounds) if isinstance(bounds, str) else bounds, F.coalesce(_number(v), F.lit(float("nan")))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(STRIPES.bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda s, step: F.when(F.get(at, s + step - 1) <= x, s + step).otherwise(s))


def _dealt(rows: DataFrame, by: str, ties: str | None) -> DataFrame:
    """rows with _s, the stripe, and _t, where ties is a number: the stripe by it among the rows of one value of by that fills a stripe alone; 0 for all others."""
    bounds = boundaries(rows, by)
    dealt = rows.crossJoin(F.broadcast(bounds)).withColumn("_s", stripe(F.col(by))).drop("_bounds")
    if ties is None:
        return dealt.withColumn("_t", F.lit(0))
    # a value that stands twice among the boundaries has a stripe's share of rows or more: at most STRIPES / 2 of them
    full = bounds.select(F.explode(F.array_distinct(F.filter("_bounds", lambda b, i: (i > 0) & (b == F.get(F.col("_bounds"), i - 1)))))).toDF("_full")
    inside = rows.select(_number(F.col(by)).alias("_full"), F.col(ties).alias("_tie")).join(F.broadcast(full), "_full").groupBy("_full").agg(sketched(F.col("_tie")).alias("_inner"))
    dealt = dealt.withColumn("_full", _number(F.col(by))).join(F.broadcast(inside), "_full", "left")
    return dealt.withColumn("_t", F.when(F.col("_inner").isNotNull(), stripe(F.col(ties), "_inner")).otherwise(F.lit(0))).drop("_full", "_inner")


def running(rows: DataFrame, by: str, name: str, then: tuple[str, ...] = (), of: str | None = None, split_ties: bool = False) -> DataFrame:
    """rows with name: the running sum of column of (ones by default, so the place from 1) in order of the number by and the columns then.

    Null and NaN come last. Rows of one value of by share a task, unless split_ties: then values that fill a stripe alone are dealt by the first of the columns then, a number.
    """
    one = F.lit(1).cast("long") if of is None else F.col(of)
    dealt = _dealt(rows, by, then[0] if split_ties else None)
    before = F.sum("_n").over(Window.orderBy("_s", "_t").rowsBetween(Window.unboundedPreceding, -1))
    # a row per stripe
    starts = dealt.groupBy("_s", "_t").agg(F.sum(one).alias("_n")).select("_s", "_t", F.coalesce(before, F.lit(0).cast("long")).alias("_at"))
    order = Window.partitionBy("_s", "_t").orderBy(F.col(by).asc_nulls_last(), *then)
    inside = F.row_number().over(order) if of is None else F.sum(one).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.join(F.broadcast(starts), ["_s", "_t"]).withColumn(name, (F.col("_at") + inside).cast("long")).drop("_s", "_t", "_at")


def counted(points: DataFrame, counts: DataFrame, wanted: dict[str, tuple[str, bool]]) -> DataFrame:
    """points with, for each column at of wanted, its name: how many rows have values below at, or up to it where inclusive; wanted: at -> (name, inclusive). counts: (v, n). Null at counts none.

    The points' different values stand among the counted ones in one order, whose running sum is read off: work is linear in both. Runs a job: what was read off is a table.
    """
    values = counts.where("v is not null and not isnan(cast(v as double))").select(F.col("v").alias("_v"), F.col("n").cast("long").alias("_c"), F.lit(1).alias("_kind"))
    asked = reduce(DataFrame.union, [points.where(F.col(at).isNotNull()).select(F.col(at).alias("_v"), F.lit(0).cast("long").alias("_c"), F.lit(2 if inclusive else 0).alias("_kind")) for at, (_, inclusive) in wanted.items()])
    found = written(running(values.unionByName(asked.distinct()), "_v", "_upto", ("_kind",), of="_c").where("_kind <> 1").select("_v", "_upto", "_kind"), "counted")
    for at, (name, inclusive) in wanted.items():
        of = found.where(F.col("_kind") == (2 if inclusive else 0)).select("_v", "_upto")
        points = points.withColumn("_v", F.col(at)).join(of, "_v", "left").withColumn(name, F.coalesce("_upto", F.lit(0).cast("long"))).drop("_v", "_upto")
    return points


def counted_up_to(points: DataFrame, counts: DataFrame, at: str, name: str, inclusive: bool) -> DataFrame:
    """counted() for one column."""
    return counted(points, counts, {at: (name, inclusive)})


def latest(points: DataFrame, values: DataFrame, wanted: dict[str, str], by: str) -> DataFrame:
    """points with, for each column at of wanted, its name: a struct of the row of values whose by is the last at or before at; a point is left out where one has no such row. An as-of join; by is distinct.

    Points and values stand in one order; each point takes the last row before it in its stripe, or else the last row of the stripes before. Runs a job: what the points take is a table.
    """
    held = F.struct(*[F.col(c) for c in values.columns])
    rows = values.where(F.col(by).isNotNull()).select(F.col(by).alias("_v"), F.lit(0).alias("_kind"), held.alias("_row"))
    asked = reduce(DataFrame.union, [points.where(F.col(at).isNotNull()).select(F.col(at).alias("_v")) for at in wanted]).distinct()
    both = _dealt(rows.unionByName(asked.select("_v", F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))), "_v", None)
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    carried = both.groupBy("_s").agg(F.max_by("_row", F.when(F.col("_kind") == 0, F.col("_v"))).alias("_last")).select("_s", before.alias("_before"))
    inside = F.last("_row", ignorenulls=True).over(Window.partitionBy("_s").orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_found", inside).where("_kind = 1").join(F.broadcast(carried), "_s").select("_v", F.coalesce("_found", "_before").alias("_found"))
    found = written(found.where("_found is not null"), "latest")
    for at, name in wanted.items():
        points = points.withColumn("_v", F.col(at)).join(found.withColumnRenamed("_found", name), "_v").drop("_v")
    return points
