"""What a planner works on: base table, cells, bins and statistics per backend, built from vectors or from a product catalogue, and kept as Parquet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import catalog, models, search, workload
from nearfield.operators.search import SearchOptions
from nearfield.plans import evaluate, router


@dataclass(frozen=True)
class State:
    """One backend: base (vec_id, vec, attr, cluster_id) and its cells (cluster_id, centroid)."""

    base: DataFrame
    cells: DataFrame


def kept(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that key below folder, made and written on first use; the key should be a hash of all that the table depends on.

    A table is written to a folder of its own and published by a manifest, <key>.json, that names it, so that a write that broke off is never read and writers at the
    same time don't touch each other's files: the first to publish has its table read by all. A manifest that names no table is an error, not an absent one.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    manifest = jvm.Path(f"{folder}/{key}.json")
    fs = manifest.getFileSystem(spark._jsc.hadoopConfiguration())

    def published() -> DataFrame:
        stream = fs.open(manifest)
        try:
            line = stream.readLine()
        finally:
            stream.close()
        try:
            named = json.loads(line or "")["table"]
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"{manifest.toString()} names no table") from e
        return spark.read.parquet(f"{folder}/{named}")

    if fs.exists(manifest):
        return published()
    table = f"{key}-{uuid.uuid4().hex}"
    make().write.parquet(f"{folder}/{table}")
    # the manifest gets its name when it is whole
    draft = jvm.Path(f"{folder}/_{table}.json")
    stream = fs.create(draft, False)
    stream.writeBytes(json.dumps({"key": key, "table": table}))
    stream.close()
    if fs.exists(manifest) or not fs.rename(draft, manifest):
        fs.delete(draft, False)
        fs.delete(jvm.Path(f"{folder}/{table}"), True)
    return published()


def vector_states(vectors: DataFrame, k: int | None = None, salt: int = 42, most: int = 1000) -> dict[str, State]:
    """Backends corr and rand over the same vectors (vec_id, vec): an attribute that follows the vectors, and one that doesn't."""
    n = k or models.n_cells(vectors.count())
    cells_of, centres = models.kmeans_cells(vectors, n)
    corr = models.blended_attribute(vectors, models.smoothed_anchors(centres), models.local_sigma(vectors, centres))
    rand = vectors.select("vec_id", (workload.draw(F.col("vec_id"), salt) % (most + 1)).alias("attr"))
    return {name: State(cells_of.join(attr, "vec_id"), centres) for name, attr in (("corr", corr), ("rand", rand))}


def product_state(products: DataFrame, embeddings: DataFrame, column: str, scale: int = 100, categorical: bool = False) -> State:
    """A backend over a catalogue: rows (vec_id and clean columns) that have the column, with its integer codes, joined to their embeddings (vec_id, vec)."""
    meta = catalog.filter_metadata(products, column, "vec_id", scale, categorical).withColumnRenamed("code", "attr")
    rows = embeddings.join(meta, "vec_id")
    own, centres = models.kmeans_cells(rows.select("vec_id", "vec"), models.n_cells(rows.count()))
    return State(own.join(meta, "vec_id"), centres)


def product_workload(state: State, share: float, selectivity: float, n: int) -> tuple[State, DataFrame]:
    """The state without its held-out queries, and n of these as queries with random ranges of a selectivity; with replacement if there are fewer."""
    split = workload.held_out(state.base, share)
    pool = split.where("part = 'query'").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    base = split.where("part = 'base'").drop("part")
    drawn = workload.sample_with_replacement(pool, n).groupBy("query_id").agg(F.count("*").alias("draws"))
    ranges = workload.random_ranges(base, pool, selectivity)
    return State(base, state.cells), pool.join(drawn, "query_id").join(ranges, "query_id")


def by_backend(queries: DataFrame, states: dict[str, State], answer: Callable[[State, DataFrame], DataFrame]) -> DataFrame:
    """answer() of each backend's queries (query_id, qvec, lo, hi, backend) over its own state, with the backend's name."""
    return reduce(DataFrame.unionByName, [answer(s, queries.where(F.col("backend") == b).drop("backend")).withColumn("backend", F.lit(b)) for b, s in states.items()])


def planned_answers(queries: DataFrame, states: dict[str, State], options: SearchOptions, n_probe: int, rule: Callable[[DataFrame], DataFrame] = router.two_route) -> DataFrame:
    """(query_id, rank, vec_id, d2, plan, backend) of a mixed workload, planned per backend."""

    def answer(s: State, q: DataFrame) -> DataFrame:
        return router.routed(s.base, evaluate.plan_queries(s.base, q, s.cells, rule), s.cells, options, n_probe)

    return by_backend(queries, states, answer)


def exact_answers(queries: DataFrame, states: dict[str, State], k: int) -> DataFrame:
    """The truth of a mixed workload, by backend."""
    return by_backend(queries, states, lambda s, q: search.ground_truth(s.base, q, k))
