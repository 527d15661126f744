"""Queries and rows met in bounded blocks: Spark deals both to parts and blocks and shuffles them, a task scores one block against one part and gives what it keeps of it, so that no pair becomes a row.

A product of matrices gives scores with a bound on their rounding; rows that this bound leaves open are scored anew in double precision, component by component in order, so that results equal those
of functions.vectors to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.ranks import STRIPES, boundaries, stripe

#: Rows of a part and queries of a block, at most about; groups that there should be at least, where blocks of LEAST queries suffice; queries scored at once; numbers of rows that are scored anew at once.
ROWS, QUERIES, GROUPS, LEAST, TILE, ANEW = 16384, 4096, 48, 256, 64, 1 << 21

_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def numeric(*columns: tuple[DataFrame, str]) -> bool:
    """Whether all columns are plain numbers, which tasks compare as Spark does."""
    return all(df.select(c).schema[0].dataType.simpleString() in _NUMBERS for df, c in columns)


def query_blocks(queries: DataFrame, parts: int) -> int:
    """How many blocks the queries are cut into. Runs a job."""
    n = queries.count()
    return max(1, -(-n // QUERIES), min(-(-GROUPS // max(parts, 1)), -(-n // LEAST)))


def dealt(rows: DataFrame, queries: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """rows and queries, both with _part, with _block: a query is in one, a row is copied to each."""
    asked = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), asked


def by_hash(base: DataFrame, queries: DataFrame, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows dealt to parts by a hash of their id, queries sent to all of them. Runs jobs, which count both."""
    parts = max(1, -(-base.count() // rows))
    return dealt(base.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")), queries.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), query_blocks(queries, parts))


def by_range(base: DataFrame, queries: DataFrame, attr: str, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows dealt to parts of neighbouring quantile stripes of attr, a stripe of very many rows to several parts; queries sent to the parts that their [lo, hi] touches. counted: what is counted in place of queries, if these stand for more. Runs jobs."""
    bounds = F.split(F.lit(",".join(map(repr, boundaries(base, attr).first()[0]))), ",").cast("array<double>")
    rows = base.where(F.col(attr).isNotNull()).withColumn("_s", stripe(F.col(attr), bounds))
    # a row per stripe
    sizes = dict(rows.groupBy("_s").count().collect())
    first, last, part, held = [], [], 0, 0
    for s in range(STRIPES):
        size = sizes.get(s, 0)
        if held and held + size > ROWS:
            part, held = part + 1, 0
        extra = max(0, -(-size // ROWS) - 1)
        first.append(part)
        last.append(part + extra)
        held, part = held + size, part + extra
    ends = [F.split(F.lit(",".join(map(str, a))), ",").cast("array<int>") for a in (first, last)]
    begin, end = (lambda s, a=a: F.get(a, s) for a in ends)
    rows = rows.withColumn("_part", (begin(F.col("_s")) + F.pmod(F.xxhash64("vec_id"), (end(F.col("_s")) - begin(F.col("_s")) + 1).cast("long"))).cast("int")).drop("_s")
    asked = queries.where("lo <= hi").withColumn("_part", F.explode(F.sequence(begin(stripe(F.col("lo"), bounds)), end(stripe(F.col("hi"), bounds)))))
    return dealt(rows, asked, query_blocks(queries if counted is None else counted, part + 1))


def by_cell(base: DataFrame, queries: DataFrame, cell: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt to parts of their cell, queries (with the cell) sent to all of these. Runs jobs, which count both."""
    most = base.groupBy(cell).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    parts = max(1, -(-most // ROWS))
    key = F.struct(cell, "_sub")
    rows = base.where(F.col(cell).isNotNull()).withColumn("_sub", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("_part", key).drop(cell, "_sub")
    asked = queries.withColumn("_sub", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_part", key).drop(cell, "_sub")
    return dealt(rows, asked, query_blocks(queries, parts))


def among(members: DataFrame, cell: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, vec, cell) that meet those of their own cell, as rows and as queries; a cell of very many rows is cut into parts and blocks of its own, others are one group. A row may be in several cells."""
    size = members.where(F.col(cell).isNotNull()).groupBy(cell).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_parts"), F.ceil(F.count("*") / QUERIES).cast("int").alias("_blocks"))
    both = members.join(size, cell).withColumn("_sub", F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int")).withColumn("_own", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("_blocks")).cast("int"))
    rows = both.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(F.struct(cell, "_sub").alias("_part"), "_block", "vec_id", "vec")
    asked = both.withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return rows, asked.select(F.struct(cell, "_sub").alias("_part"), F.col("_own").alias("_block"), F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))


def _by_width(t: pa.Table, column: str) -> dict[int, tuple[pa.Table, np.ndarray]]:
    """The rows of each vector length with their matrix; rows without a vector, or with a null in it, are left out."""
    vecs = t.column(column).combine_chunks()
    width = pc.list_value_length(vecs)
    out = {}
    for w in pc.unique(width.drop_null()).to_pylist():
        some = t.filter(pc.fill_null(pc.equal(width, w), False))
        flat = some.column(column).combine_chunks().flatten()
        if flat.null_count:
            whole = np.asarray(flat.is_valid()).reshape(-1, w).all(axis=1)
            some = some.filter(pa.array(whole))
            flat = some.column(column).combine_chunks().flatten()
        out[w] = some, np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(some.num_rows, w)
    return out


def _numbers(t: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's values and which of them are there."""
    c = t.column(column).combine_chunks()
    return pc.fill_null(c, 0).to_numpy(zero_copy_only=False), np.asarray(c.is_valid())


class _Part:
    """Rows of one part in order of their ids, and their scores against queries: squared distances, or inner products with their sign turned, so that the smaller is the nearer."""

    def __init__(self, table: pa.Table, x: np.ndarray, inner: bool) -> None:
        self.table, self.x, self.inner = table, x, inner
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.einsum("ij,ij->i", x, x)
        self.wild = np.flatnonzero(~(norm < 1e200))  # scored anew always: sums may leave the range of a double
        self.norm = np.where(norm < 1e200, norm, 0)
        self.off = 4 * (x.shape[1] + 8) * np.finfo(np.float64).eps
        self.xt = np.ascontiguousarray(np.where((norm < 1e200)[:, None], x, 0).T)

    def about(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of q against all rows, but for a term of the query alone, and that term; a score may be off by off * (norm of the row + norm of the query)."""
        own = np.einsum("ij,ij->i", q, q)
        if self.inner:
            return -q @ self.xt, np.zeros(len(q))
        score = (-2 * q) @ self.xt
        score += self.norm
        return score, own

    def exact(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores of the pairs of query i and row j, summed up component by component."""
        out, step = np.zeros(len(i)), max(1, ANEW // max(1, self.x.shape[1]))
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(i), step):
                a, b = np.ascontiguousarray(self.x[j[at : at + step]].T), np.ascontiguousarray(q[i[at : at + step]].T)
                terms = a * b if self.inner else (a - b) * (a - b)
                for term in terms:
                    out[at : at + step] += term
        return -out if self.inner else out


def _tiles(rows: pa.Table, asked: pa.Table, inner: bool) -> Iterator[tuple[_Part, pa.Table, np.ndarray]]:
    """Each part's rows with TILE queries at a time of the same vector length."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("vec_id", "ascending")], null_placement="at_start"))
    queries = _by_width(asked, "qvec")
    for width, (table, x) in _by_width(rows, "vec").items():
        if width in queries and table.num_rows:
            part, (own, q) = _Part(table, x, inner), queries[width]
            for at in range(0, len(q), TILE):
                yield part, own.slice(at, TILE), q[at : at + TILE]


def _inside(part: _Part, own: pa.Table, attr: str) -> np.ndarray:
    """Which rows are in the range of which queries, as Spark compares numbers: NaN is the largest."""
    (v, there), (lo, has_lo), (hi, has_hi) = _numbers(part.table, attr), _numbers(own, "lo"), _numbers(own, "hi")
    nan = np.isnan(v) if v.dtype.kind == "f" else np.zeros(len(v), bool)
    open_ = np.isnan(hi) if hi.dtype.kind == "f" else np.zeros(len(hi), bool)
    return ((v >= lo[:, None]) | nan) & ((v <= hi[:, None]) | open_[:, None]) & there & (has_lo & has_hi)[:, None]


def _ids(c: pa.ChunkedArray) -> np.ndarray:
    return c.combine_chunks().to_numpy(zero_copy_only=False)


def nearest(rows: DataFrame, asked: DataFrame, k: int | None, inner: bool = False, attr: str | None = None, others: bool = False) -> DataFrame:
    """(query_id, vec_id, score): of each part at least those rows that are among a query's k nearest, ties to the smaller id; k may be a column k of asked.

    rows: _part, _block, vec_id, vec and attr, if only rows in the range of asked (_part, _block, query_id, qvec, lo, hi) count; others: rows with the query's own id don't. Vectors that are null, hold a null or
    differ in length from the query's have no score and are not returned.
    """

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        if others:
            left, right = left.filter(left.column("vec_id").is_valid()), right.filter(right.column("query_id").is_valid())
        queries, found, scores = [], [], []
        for part, own, q in _tiles(left, right, inner):
            n = len(part.x)
            wanted = np.full(len(q), k) if k is not None else _numbers(own, "k")[0]
            with np.errstate(over="ignore", invalid="ignore"):
                key, _ = part.about(q)
                size = np.einsum("ij,ij->i", q, q)
            key += part.off * part.norm
            ok = _inside(part, own, attr) if attr else None
            if others:
                ids, mine = _ids(part.table.column("vec_id")), _ids(own.column("query_id"))
                ok = np.ones(key.shape, bool) if ok is None else ok
                for i, (a, b) in enumerate(zip(np.searchsorted(ids, mine, "left"), np.searchsorted(ids, mine, "right"), strict=True)):
                    ok[i, a:b] = False
            key[:, part.wild] = np.inf
            if ok is not None:
                key[~ok] = np.inf
            key[np.isnan(key)] = np.inf
            at = np.minimum(wanted, n) - 1
            ends = np.unique(at)
            if n <= ends[-1] + 1:
                least = np.full(len(q), np.inf)
            elif len(ends) == 1:
                least = np.partition(key, ends[0], axis=1)[:, ends[0]]
            else:
                least = np.array([np.partition(row, a)[a] for row, a in zip(key, at, strict=True)])
            with np.errstate(invalid="ignore"):
                near = key <= (least + 2 * part.off * size)[:, None] + 2 * part.off * part.norm
            near[~(size < 1e200)] = True
            near[:, part.wild] = True
            if ok is not None:
                near &= ok
            i, j = np.nonzero(near)
            d = part.exact(q, i, j)
            # the smallest first, NaN last; of inner products NaN is the largest and first. Rows stand in order of ids
            order = np.lexsort((j, np.where(np.isnan(d), -np.inf, d) if inner else d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i, "left")
            keep = place < wanted[i]
            queries.append(own.column("query_id").take(pa.array(i[keep])))
            found.append(part.table.column("vec_id").take(pa.array(j[keep])))
            scores.append(pa.array(-d[keep] if inner else d[keep]))
        names = ["query_id", "vec_id", "score"]
        tables = [pa.table(list(c), names=names) for c in zip(queries, found, scores, strict=True)]
        if tables:
            return pa.concat_tables(tables)
        return pa.table([right.column("query_id").slice(0, 0), left.column("vec_id").slice(0, 0), pa.array([], pa.float64())], names=names)

    keys = ["_part", "_block"]
    left = rows.select(*keys, "vec_id", F.col("vec").cast("array<double>").alias("vec"), *([attr] if attr else []))
    right = asked.select(*keys, "query_id", F.col("qvec").cast("array<double>").alias("qvec"), *(["lo", "hi"] if attr else []), *([F.col("k").cast("long").alias("k")] if k is None else []))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, schema)


def scored(rows: DataFrame, asked: DataFrame, attr: str) -> DataFrame:
    """(query_id, vec_id, attr, score): squared distances of the rows that each query names, if not above its bound; rows: _part, _block, vec_id, vec, attr; asked: _part, _block, query_id, qvec, ids, an array of vec_id, and bound. Rows that nearest() leaves out are left out."""
    names = ["query_id", "vec_id", attr, "score"]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for part, own, q in _tiles(left, right, False):
            ids, wanted = _ids(part.table.column("vec_id")), own.column("ids").combine_chunks()
            i = np.repeat(np.arange(len(q)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            flat = wanted.flatten().to_numpy(zero_copy_only=False)
            j = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            there = np.asarray(ids[j] == flat, bool)
            i, j = i[there], j[there]
            d = part.exact(q, i, j)
            keep = ~(d > _numbers(own, "bound")[0][i])
            i, at = pa.array(i[keep]), pa.array(j[keep])
            out.append(pa.table([own.column("query_id").take(i), part.table.column("vec_id").take(at), part.table.column(attr).take(at), pa.array(d[keep])], names=names))
        if out:
            return pa.concat_tables(out)
        return pa.table([right.column("query_id").slice(0, 0), left.column("vec_id").slice(0, 0), left.column(attr).slice(0, 0), pa.array([], pa.float64())], names=names)

    keys = ["_part", "_block"]
    left = rows.select(*keys, "vec_id", F.col("vec").cast("array<double>").alias("vec"), attr)
    right = asked.select(*keys, "query_id", F.col("qvec").cast("array<double>").alias("qvec"), "ids", "bound")
    kind = [asked.schema["query_id"], rows.schema["vec_id"], rows.schema[attr]]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", score double")


def nearer(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, counts array<long>): for each hit of a query how many rows of a part stand before it in order of squared distance and id; asked: _part, _block, query_id, qvec, at array<struct<d2, vec_id>> in that order."""

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, counts = [], []
        for part, own, q in _tiles(left, right, False):
            with np.errstate(over="ignore", invalid="ignore"):
                key, term = part.about(q)
                key += term[:, None]
                size = np.einsum("ij,ij->i", q, q)
            ids, all_at = _ids(part.table.column("vec_id")), own.column("at").combine_chunks()
            for row in range(len(q)):
                hits = all_at[row].values
                hit_d = np.asarray(hits.field("d2").to_numpy(zero_copy_only=False), np.float64)
                hit_d, hit_id = np.where(np.isnan(hit_d), np.inf, hit_d), hits.field("vec_id").to_numpy(zero_copy_only=False)
                off = part.off * (part.norm + size[row])
                low, high = np.searchsorted(hit_d, key[row] - off, "left"), np.searchsorted(hit_d, key[row] + off, "right")
                sure = low == high
                sure[part.wild] = False
                if not size[row] < 1e200:
                    sure[:] = False
                before = np.cumsum(np.bincount(low[sure], minlength=len(hit_d) + 1))[: len(hit_d)]
                j = np.flatnonzero(~sure)
                for at in range(0, len(j), 1 << 16):
                    some = j[at : at + (1 << 16)]
                    d = part.exact(q, np.full(len(some), row), some)
                    d = np.where(np.isnan(d), np.inf, d)[:, None]
                    before = before + ((d < hit_d) | ((d == hit_d) & (ids[some][:, None] < hit_id))).sum(axis=0)
                counts.append(before.tolist())
            queries.append(own.column("query_id"))
        names = ["query_id", "counts"]
        if queries:
            return pa.table([pa.chunked_array([c for q in queries for c in q.chunks]), pa.array(counts, pa.list_(pa.int64()))], names=names)
        return pa.table([right.column("query_id").slice(0, 0), pa.array([], pa.list_(pa.int64()))], names=names)

    keys = ["_part", "_block"]
    left = rows.select(*keys, "vec_id", F.col("vec").cast("array<double>").alias("vec"))
    right = asked.select(*keys, "query_id", F.col("qvec").cast("array<double>").alias("qvec"), "at")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, f"query_id {asked.schema['query_id'].dataType.simpleString()}, counts array<bigint>")


__all__ = ["among", "by_cell", "by_hash", "by_range", "nearer", "nearest", "numeric", "scored"]
