"""Helpers that several corpus operators share: scratch tables, word hashing on Arrow buffers, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits a stage's text into pieces of about this many bytes where a stage needs a number of partitions.
SHARD_BYTES = 4 << 20
#: The separators between words, as in the class [\x20\x09-\x0D].
WORD_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def _class(*ranges: tuple[int, int]) -> str:
    """A character class of single characters, which regular expressions look up in one table."""
    return "".join(f"\\x{c:02X}" for a, b in ranges for c in range(a, b + 1))


#: Words of letters and digits: everything but ASCII marks, spaces and controls. A-Z in capitals are letters here, which saves lower-casing whole texts.
ALNUM_WORD = f"[^{_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))}]+"
#: Words between white space.
SPACE_WORD = f"[^{_class((0x20, 0x20), (0x09, 0x0D))}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """The folder for tables between stages: spark.checkpoint.dir; where that is unset, a new folder in local mode (tests), an error on a cluster, whose executors share no such folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: stages need a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of the jobs inside go as soon as each job has ended, as its result is stored."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Lists that take note of the scratch paths made while noted() is open.
_NOTES: list[list[str]] = []


@contextmanager
def noted():
    """A list of the scratch paths made inside."""
    _NOTES.append(made := [])
    try:
        yield made
    finally:
        _NOTES[:] = [other for other in _NOTES if other is not made]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _NOTES:
        made.append(path)
    return path


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back: cuts lineage and survives lost executors. codec: zstd for texts that are read often."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing needs any more."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- columns


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the lambda reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, cast-free; missing ones are errors, further ones are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


# ---------------------------------------------------------------- words of Arrow strings


def _table(lower: bool) -> np.ndarray:
    rng = np.random.default_rng(20240229)
    t = rng.integers(0, _MASK, 256, dtype=np.uint64, endpoint=True)
    if lower:
        t[65:91] = t[97:123]
    return t


_TABLES = {True: _table(True), False: _table(False)}
_POW = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if _POW["n"] < n:
        n = max(n, 1 << 16)
        inv = pow(int(_BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POW["up"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _BASE, np.uint64))])
            _POW["down"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, np.uint64(inv), np.uint64))])
        _POW["n"] = n
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a splitmix-style finish)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_SPACE)] = True


class Words:
    """Words of whole texts: per word its 64-bit hash, start and end byte; per text the range of its words."""

    __slots__ = ("raw", "hash", "start", "end", "first")

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool) -> None:
        self.raw = raw
        gap = np.empty(len(raw) + 1, bool)
        gap[:-1] = _SPACE[raw]
        gap[-1] = True
        begins = ~gap[:-1]
        begins[1:] &= gap[:-2] if len(raw) else gap[:0]
        edges = off[1:-1]
        edges = edges[edges < len(raw)]
        if len(edges):
            begins[edges] = ~gap[edges]  # a text starts a word of its own
        self.start = np.flatnonzero(begins)
        stop = gap[1:].copy()
        if len(edges):
            stop[edges[edges > 0] - 1] = True
        self.end = np.flatnonzero(~gap[:-1] & stop) + 1
        self.first = np.searchsorted(self.start, off)
        h = np.empty(len(self.start), np.uint64)
        table = _TABLES[lower]
        # pieces keep the running sums in cache and the powers short
        step, i = 1 << 18, 0
        with np.errstate(over="ignore"):
            while i < len(h):
                a = self.start[i]
                j = max(i + 1, int(np.searchsorted(self.start, a + step)))
                b = self.end[j - 1]
                up, down = _powers(int(b - a) + 1)
                run = np.zeros(b - a + 1, np.uint64)
                np.cumsum(table[raw[a:b]] * up[: b - a], out=run[1:])
                s, e = self.start[i:j] - a, self.end[i:j] - a
                h[i:j] = (run[e] - run[s]) * down[s]
                i = j
        self.hash = mix(h)

    def text(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def words_of(texts: pa.Array, lower: bool) -> Words:
    return Words(*utf8(texts), lower)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive values of h (for all of h, texts not told apart): len(h) - n + 1 of them."""
    if len(h) < n:
        return h[:0]
    up, down = _powers(len(h) + n)
    with np.errstate(over="ignore"):
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=run[1:])
        return mix((run[n:] - run[:-n]) * down[: len(h) - n + 1])


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's long."""
    return h.view(np.int64)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node reachable, for each node of edges, by alternating star contraction.

    Every round rewrites the edges to point at smaller nodes; minima are pre-aggregated and the joins are plain equi-joins that Spark splits
    when a hub is skewed. Each round is a table in the scratch folder, so nothing is gathered on the driver but a count and a checksum.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, before = cut(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own, so that both sides of the join are plain shuffles, of which Spark splits a hub's partition
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        new = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        drop(e, low)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # at the fixed point each node's only edge goes to its component's smallest node
    out = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return out.unionByName(roots)


# ---------------------------------------------------------------- Arrow batches


def give_back() -> None:
    """Return a worker's freed memory to the system: workers stay between tasks, and several share an executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches, column: str, limit: int = SHARD_BYTES):
    """Record batches cut into slices of at most about limit bytes of a text column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        size = np.cumsum(np.asarray(pa.compute.binary_length(col).fill_null(0), dtype=np.int64) + 8)
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def whole_runs(batches, key: str):
    """Tables from batches sorted by an integer key, cut only between keys."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if carry and carry[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(carry)
            carry = []
        last = len(k) - int(np.argmax(k[::-1] != k[-1])) if k[0] != k[-1] else 0  # the last key's run may go on
        if last:
            yield pa.Table.from_batches([*carry, batch.slice(0, last)])
            carry = []
        carry.append(batch.slice(last))
    if carry:
        yield pa.Table.from_batches(carry)
    give_back()


def run_bounds(k: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length."""
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]).astype(np.int64)


def lists(values: np.ndarray, first: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
