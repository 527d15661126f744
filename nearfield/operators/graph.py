"""A neighbour graph as a table, built from overlapping cells, and filtered search along it.

knn_graph() deals rows to the cells of pivots drawn from them, several cells a row, finds neighbours inside cells, and does so again with other pivots until few lists change. filtered_search() keeps a beam of the nearest rows of each
query and a table of those it has scored, and expands the beam by joins with the graph; where few neighbours are in range, those out of it are passed over to their own neighbours, so that the rows in range stay connected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators import blocks
from nearfield.operators.ranks import counted
from nearfield.operators.search import in_range, small, top_k
from nearfield.tables import remove, written

#: Rows of a cell, on average; cells that a row is in; pivots at most; nearest pivots among which equal distances are settled by hash, so that copies of one vector are spread over their pivots.
CELL, OVER, PIVOTS, EVEN = 4096, 3, 4096, 32
#: Rounds of the graph end when one changes this share of edges or less. Rounds draw their pivots anew: if one finds a share r of the edges, what is still missing then is (1 - r) / r of what it changed.
SETTLED = 0.1
#: A vertex with fewer neighbours in range than this is passed on to its neighbours' neighbours; a search starts at a row of so many, up to a number of rows; with fewer known rows in range than LEADS, rows out of it lead on.
FEW, EVERY, STARTS, LEADS = 8, 24, 4096, 48
#: Groups in which a round's rows are scored, at least, where there are queries enough.
TASKS = 24


def _cells(vectors: DataFrame, n: int, over: int, turn: int) -> DataFrame:
    """(vec_id, cell): the cells of the nearest over of this round's pivots. Runs jobs."""
    pivots = min(PIVOTS, -(-n * over // CELL))
    drawn = written(vectors.orderBy(F.xxhash64("vec_id", F.lit(turn)), "vec_id").limit(pivots), "pivots")  # a bounded number
    near = blocks.nearest(*blocks.by_hash(drawn, vectors.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))), min(pivots, max(over, EVEN)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", F.xxhash64("query_id", "vec_id")))
    return near.withColumn("r", rank).where(F.col("r") <= over).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("cell"))


def knn_graph(vectors: DataFrame, k: int = 16, rounds: int = 12, over: int = OVER) -> DataFrame:
    """(vec_id, nbr, d2): about the k nearest of each row of vectors (vec_id, vec) by distance, itself left out; all others, if there are fewer. Exact where all rows fit in one cell, else approximate; ties go to the smaller id.

    vec_id is distinct and not null, vectors are of one length. A round compares a row with those of its over cells, whose mean size does not grow with the table up to PIVOTS cells. Runs jobs: a table or two a round.
    """
    vectors = written(vectors.where("vec_id is not null and vec is not null").select("vec_id", F.transform("vec", lambda x: x.cast("double")).alias("vec")), "graph-vectors")
    n = vectors.count()
    k = min(k, max(n - 1, 0))
    if not k:
        return vectors.limit(0).select("vec_id", F.col("vec_id").alias("nbr"), F.lit(0.0).alias("d2"))
    edges = None
    for turn in range(rounds):
        if n <= CELL:
            members = vectors.withColumn("cell", F.lit(0))
        else:
            cells = written(_cells(vectors, n, over, turn), "cells")
            members = cells.join(vectors, "vec_id")
        found = blocks.nearest(*blocks.among(members, "cell"), k, others=True).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("nbr"), F.col("score").alias("d2"), F.lit(1).alias("_from"))
        both = found if edges is None else found.unionByName(edges.withColumn("_from", F.lit(0)))
        # a pair may have met in several cells, and before
        both = both.groupBy("vec_id", "nbr").agg(F.min("d2").alias("d2"), F.min("_from").alias("_from"))
        after = written(top_k(both, k, of="vec_id", tie="nbr").select("vec_id", "nbr", "d2", "_from"), "graph")
        if n > CELL:
            remove(cells)
        if edges is not None:
            remove(edges)
        edges = after.drop("_from")
        edges.path = after.path
        if n <= CELL or after.where("_from = 1").count() <= SETTLED * n * k:
            break
    remove(vectors)
    return edges


def adjacency(base: DataFrame, graph: DataFrame, attr: str = "attr") -> DataFrame:
    """(vec_id, nbrs array<struct<id, attr>>): a row per vertex, its neighbours in both directions with their attributes; base: vec_id, attr."""
    both = graph.select("vec_id", "nbr").union(graph.select(F.col("nbr").alias("vec_id"), F.col("vec_id").alias("nbr"))).distinct()
    # a vertex that very many have as a neighbour keeps those that are hashed first: its own list is whole
    own = graph.select("vec_id", "nbr", F.lit(True).alias("own"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("own").isNull(), F.xxhash64("vec_id", "nbr"), "nbr"))
    both = both.join(own, ["vec_id", "nbr"], "left").withColumn("r", rank).where(F.col("own").isNotNull() | (F.col("r") <= 256))
    named = both.join(base.select(F.col("vec_id").alias("nbr"), F.col(attr).alias("attr")), "nbr")
    return named.groupBy("vec_id").agg(F.collect_list(F.struct(F.col("nbr").alias("id"), "attr")).alias("nbrs"))


def filtered_search(base: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 10, beam: int = 160, entries: int = 256, rounds: int = 24, attr: str = "attr") -> DataFrame:
    """(query_id, rank, vec_id, d2, scored): approximately the k nearest rows in range, found along the graph; scored: how many rows were compared with the query.

    base: vec_id, vec, attr; graph: knn_graph(); queries: query_id, qvec, lo, hi. A query starts at the nearest of a sample of rows (entries, or more in large tables) and at the nearest of those in range. A round expands the beam nearest
    rows that it has not expanded: their neighbours in range, and where these are few, the neighbours in range of those out of range. While fewer than LEADS rows in range are known, the nearest out of range lead on. It ends when
    all of the beam is expanded. Ranges of so few rows that the beam holds them, or that the sample may miss them, are scored whole. Runs jobs: two tables a round.
    """
    base = written(base.where("vec_id is not null").select("vec_id", "vec", F.col(attr).alias("attr")), "graph-rows")
    asked = written(queries.select("query_id", "qvec", "lo", "hi"), "asked")
    links = written(adjacency(base, graph), "adjacency")
    n = base.count()
    starts = max(entries, min(STARTS, n // EVERY))
    few = max(beam, 8 * n // starts)
    values = base.groupBy(F.col("attr").alias("v")).agg(F.count("*").alias("n"))
    held = counted(asked.where("lo <= hi").select("query_id", "lo", "hi"), values, {"hi": ("upto", True), "lo": ("below", False)}).select("query_id", (F.col("upto") - F.col("below")).alias("m"))
    held = written(held.where("m > 0"), "held")
    narrow = asked.join(held.where(F.col("m") <= few), "query_id")
    whole = in_range(base, narrow.drop("m"), k).join(held, "query_id").select("query_id", "vec_id", "d2", F.col("m").alias("scored"))
    walking = written(asked.join(held.where(F.col("m") > few).select("query_id"), "query_id"), "walking")
    parts = max(1, -(-n // blocks.ROWS))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    rows = base.withColumn("_part", part("vec_id"))
    limits = small(walking.select("query_id", "lo", "hi"))
    within = F.coalesce(F.col("attr").between(F.col("lo"), F.col("hi")), F.lit(False))

    start = written(base.orderBy(F.xxhash64("vec_id", F.lit("entry")), "vec_id").limit(starts), "entries")  # a bounded number
    anywhere = top_k(blocks.nearest(*blocks.by_hash(start, walking.select("query_id", "qvec")), beam).withColumnRenamed("score", "d2"), beam).select("query_id", "vec_id", "d2")
    first = top_k(in_range(start, walking, beam), beam).select("query_id", "vec_id", "d2").unionByName(anywhere).distinct()
    first = first.join(start.select("vec_id", "attr"), "vec_id").join(limits, "query_id").select("query_id", "vec_id", "d2", within.alias("within"))
    first = written(first, "found")
    # what each round scores, and its beams; queries that have nothing left to expand stay in the table of their last round
    named, beams, new = [written(first.groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")), "named")], [], first
    for turn in range(rounds):
        known = new.withColumn("done", F.lit(False))
        if beams:
            known = known.unionByName(beams[-1].where("active").select("query_id", "vec_id", "d2", "within", (F.col("done") | F.col("front")).alias("done")))
        r = F.row_number().over(Window.partitionBy("query_id", "within").orderBy("d2", "vec_id"))
        of = Window.partitionBy("query_id")
        n_in = F.sum(F.col("within").cast("long")).over(of)
        best = known.withColumn("r", r).where(F.col("r") <= beam).withColumn("n_in", n_in).withColumn("worst", F.max(F.when(F.col("within"), F.col("d2"))).over(of))
        # rows in range count for the beam; while there are few, the nearest out of range lead on
        leads = F.col("within") | (F.col("r") <= F.greatest(F.lit(4), F.lit(LEADS) - F.col("n_in")))
        # a full beam takes nothing that is farther than its last
        bound = F.when(F.col("n_in") >= beam, F.col("worst")).otherwise(F.lit(float("inf")))
        best = best.withColumn("front", ~F.col("done") & leads).withColumn("active", F.max("front").over(of) & F.lit(turn < rounds - 1))
        beams.append(written(best.select("query_id", "vec_id", "d2", "within", "done", "front", "active", (F.col("n_in") < LEADS).alias("open"), bound.alias("bound")), "beam"))
        front = beams[-1].where("front and active").select("query_id", "vec_id", "open")
        active = beams[-1].where("active").groupBy("query_id").agg(F.max("bound").alias("bound"))
        asking = active.count()
        if not asking:
            break
        going = small(active)
        inside = lambda x: F.coalesce(x["attr"].between(F.col("lo"), F.col("hi")), F.lit(False))
        met = front.join(links, "vec_id").join(limits, "query_id").select("query_id", "lo", "hi", "open", "nbrs", F.filter("nbrs", inside)["id"].alias("near"))
        found = met.select("query_id", F.when(F.col("open"), F.col("nbrs.id")).otherwise(F.col("near")).alias("ids"))
        second = met.where(F.size("near") < FEW).select("query_id", "lo", "hi", F.explode(F.filter("nbrs", lambda x: ~inside(x))["id"]).alias("vec_id")).distinct().join(links, "vec_id")
        found = found.unionByName(second.select("query_id", F.filter("nbrs", inside)["id"].alias("ids"))).where(F.size("ids") > 0)
        found = found.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        seen = reduce(DataFrame.unionByName, named).join(going.select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(F.flatten(F.collect_list("ids")).alias("seen"))
        named.append(written(found.join(seen, "query_id", "left").select("query_id", F.array_except("ids", F.coalesce("seen", F.array().cast(found.schema["ids"].dataType))).alias("ids")), "named"))
        # a row is copied to each block of the queries that go on
        cut = max(-(-asking // blocks.QUERIES), min(-(-TASKS // parts), -(-asking // blocks.LEAST)))
        to_score = named[-1].select("query_id", F.explode("ids").alias("vec_id")).groupBy("query_id", part("vec_id").alias("_part")).agg(F.collect_list("vec_id").alias("ids"))
        to_score = to_score.join(going, "query_id").join(small(walking.select("query_id", "qvec")), "query_id")
        scored = blocks.scored(*blocks.dealt(rows, to_score, cut), "attr").join(limits, "query_id")
        new = scored.select("query_id", "vec_id", F.col("score").alias("d2"), within.alias("within"))
    counts = reduce(DataFrame.unionByName, named[1:], named[0].limit(0)).select("query_id", F.size("ids").cast("long").alias("scored"))
    counts = counts.unionByName(walking.select("query_id", F.lit(min(starts, n)).cast("long").alias("scored"))).groupBy("query_id").agg(F.sum("scored").alias("scored"))
    walked = reduce(DataFrame.unionByName, [t.where("not active and within") for t in beams]).select("query_id", "vec_id", "d2").join(counts, "query_id")
    out = written(top_k(walked.unionByName(whole), k).select("query_id", "rank", "vec_id", "d2", "scored"), "found")
    remove(base, asked, links, held, walking, start, first, *named, *beams)
    return out
