"""Quantiles of ever longer prefixes, with work linear in the rows.

Values are dealt to stripes between their quantiles, and places to blocks. A block knows how many rows of each stripe stand before it, so that it finds, for each of its checkpoints, the stripe of the wanted rank
and the rank inside it; the stripe then has the rows among which it is taken. A value that is itself a boundary has a stripe of its own, however many rows have it, which needs no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.ranks import STRIPES, sketched, stripe
from nearfield.tables import written

#: Places of a block, and rows that are merged at once into a stripe's sorted values.
BLOCK, CHUNK = 1 << 16, 4096


def fine_stripes(rows: DataFrame, bounds: DataFrame, key: list[str], value: str) -> DataFrame:
    """rows with _s: even for values that are the boundary itself, at which their stripe begins, and odd for those between. bounds: the key's columns and _bounds."""
    dealt = rows.join(F.broadcast(bounds), key).withColumn("_n", stripe(F.col(value)))
    return dealt.withColumn("_s", (2 * F.col("_n") + F.when((F.col("_n") > 0) & (F.get("_bounds", F.col("_n") - 1) == F.col(value)), 0).otherwise(1)).cast("int")).drop("_n", "_bounds")


def _column(t: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return t.column(name).to_numpy().astype(kind)


def _stripes_of_ranks(share: float):
    def of(here: pa.Table, before: pa.Table) -> pa.Table:
        """A block's checkpoints with the stripes of the ranks about their quantile."""
        count = np.zeros(2 * STRIPES, np.int64)
        if before.num_rows:
            count[_column(before, "_s")] = _column(before, "c")
        point = np.asarray(here.column("_s").is_null())
        points, rows = np.sort(_column(here, "at")[point]), here.filter(pa.array(~point)).sort_by("at")
        at, s, done, out = _column(rows, "at"), _column(rows, "_s"), 0, ([], [], [], [])
        for p in points.tolist():
            upto = int(np.searchsorted(at, p, "right"))
            count += np.bincount(s[done:upto], minlength=2 * STRIPES)
            done, total = upto, np.cumsum(count)
            if not total[-1]:
                continue
            place = (int(total[-1]) - 1) * share
            k = int(place)
            for rank, weight in ((k, 1 - (place - k)), (k + 1, place - k)):
                if weight > 0:
                    at_stripe = int(np.searchsorted(total, rank, "right"))
                    for column, x in zip(out, (p, at_stripe, rank - int(total[at_stripe] - count[at_stripe]), weight), strict=True):
                        column.append(x)
        series = pa.array([here.column("series")[0].as_py() if here.num_rows else None] * len(out[0]), pa.string())
        return pa.table([series, *[pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)]], ["series", "at", "_s", "k", "weight"])

    return of


def select_in_prefixes(at: np.ndarray, v: np.ndarray, points: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each point the k-th smallest (from 0) of the values whose place is not above it."""
    order, asked = np.argsort(at, kind="stable"), np.argsort(points, kind="stable")
    at, v, old, done, out = at[order], v[order], np.zeros(0, v.dtype), 0, np.empty(len(points), v.dtype)
    for i in asked:
        upto = int(np.searchsorted(at, points[i], "right"))
        if upto - done > CHUNK:
            old, done = np.sort(np.concatenate([old, v[done:upto]]), kind="stable"), upto
        new = np.sort(v[done:upto])
        place = np.searchsorted(old, new, "right") + np.arange(len(new))
        j = int(np.searchsorted(place, k[i]))
        out[i] = new[j] if j < len(new) and place[j] == k[i] else old[k[i] - j]
    return out


def _select(rows: pa.Table, asks: pa.Table) -> pa.Table:
    """The asked ranks' values, times their weights, among a stripe's rows."""
    part = np.zeros(0)
    if asks.num_rows:
        part = select_in_prefixes(_column(rows, "at"), _column(rows, "v", np.float64), _column(asks, "at"), _column(asks, "k")) * _column(asks, "weight", np.float64)
    return pa.table([asks.column("series").cast(pa.string()), asks.column("at").cast(pa.int64()), pa.array(part, pa.float64())], ["series", "at", "part"])


def prefix_quantiles(rows: DataFrame, points: DataFrame, share: float) -> DataFrame:
    """(series, at, tau) for points (series, at): the quantile, interpolated, of the values of the series' rows whose place is not above at. A point before all values gives no row.

    rows: series, at (a place from 1 on), v; nulls of v are left out, and there are no infinities or NaN. The number of series is small: each has a row of boundaries.
    Runs a job: the rows are read several times, from a table.
    """
    rows = written(rows.where("v is not null").select("series", F.col("at").cast("long").alias("at"), F.col("v").cast("double").alias("v")), "prefix-rows")
    bounds = rows.groupBy("series").agg(sketched(F.col("v")).alias("_bounds"))
    block = F.floor((F.col("at") - 1) / BLOCK).cast("long")
    dealt = fine_stripes(rows, bounds, ["series"], "v").withColumn("g", block)
    counts = dealt.groupBy("series", "g", "_s").agg(F.count("*").alias("c"))
    wanted = points.select("series", F.col("at").cast("long").alias("at")).distinct().withColumn("g", block)
    # what each block has before it: blocks of BLOCK places times stripes
    grid = counts.select("series", "_s").distinct().join(wanted.select("series", "g").union(counts.select("series", "g")).distinct(), "series").join(counts, ["series", "g", "_s"], "left")
    before = F.sum("c").over(Window.partitionBy("series", "_s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    base = grid.withColumn("c", before).where("c is not null")
    both = dealt.select("series", "g", "at", "_s").unionByName(wanted.withColumn("_s", F.lit(None).cast("int")))
    both, base = both.toDF(*both.columns), base.toDF(*base.columns)  # columns of their own, for the cogroup
    asks = both.groupBy("series", "g").cogroup(base.groupBy("series", "g")).applyInArrow(_stripes_of_ranks(share), "series string, at long, _s int, k long, weight double")
    own = asks.where("_s % 2 = 0").join(F.broadcast(bounds), "series").select("series", "at", (F.get("_bounds", (F.col("_s") / 2).cast("int") - 1) * F.col("weight")).alias("part"))
    dealt = dealt.toDF(*dealt.columns)
    between = dealt.where("_s % 2 = 1").groupBy("series", "_s").cogroup(asks.where("_s % 2 = 1").groupBy("series", "_s")).applyInArrow(_select, "series string, at long, part double")
    return own.unionByName(between).groupBy("series", "at").agg(F.sum("part").alias("tau"))
