"""Readers and writers of vector, range, manifest and report files."""

from __future__ import annotations

import io
import struct
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.scalars import finite, selectivity_of_name
from nearfield.session import ship
from nearfield.sources.vecfiles import VectorFiles, reaches

CLASSES = ("positive", "negative", "random")


def _vectors(spark: SparkSession, path: str, kind: str, element: str) -> DataFrame:
    """Files of rows of a 4-byte length and that many 4-byte values; a row's id is its place in its file after the rows of the files before, by path."""

    def of(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                if not len(data):
                    continue
                d = struct.unpack_from("<i", data)[0]
                if d <= 0 or len(data) % (4 * (d + 1)):
                    raise ValueError(f"{name}: not a whole number of vectors")
                m = np.frombuffer(data, "<i4").reshape(-1, d + 1)
                if (m[:, 0] != d).any():
                    raise ValueError(f"{name}: vectors of different lengths")
                rows = m[:, 1:].view(kind)
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    yield pd.DataFrame({"path": name, "row": np.arange(at, at + len(part)), "embedding": list(part)})

    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path", "content").mapInPandas(of, f"path string, row long, embedding array<{element}>")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy("path").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    return rows.join(start.select("path", "start"), "path").select((F.col("start") + F.col("row")).alias("vec_id"), "embedding")


def _by_bytes(spark: SparkSession, path: str, kind: str, rows: int | None = None) -> DataFrame:
    """A file, or a folder's files, split by bytes."""
    ship(spark)
    spark.dataSource.register(VectorFiles)
    options = {"path": path, "kind": kind} | ({} if rows is None else {"rows": str(rows)})
    return spark.read.format("vecfiles").options(**options).load()


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding array<float>) of .fvecs files; wrong lengths are errors. Files are split by bytes over tasks; on a file system that only Spark reaches, a file is one task's work."""
    return _by_bytes(spark, path, "fvecs") if reaches(path) else _vectors(spark, path, "<f4", "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding array<int>) of .ivecs files, as read_fvecs() does."""
    return _by_bytes(spark, path, "ivecs") if reaches(path) else _vectors(spark, path, "<i4", "int")


def _write_by_bytes(rows: DataFrame, path: str, kind: str, mode: str) -> None:
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(VectorFiles)
    rows.write.format("vecfiles").option("kind", kind).option("path", path).mode(mode).save()


def write_fvecs(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """vectors (vec_id, embedding) as .fvecs parts in order of vec_id, which reading then numbers from 0. Parts become visible when all are written."""
    _write_by_bytes(vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("vec_id", F.col("embedding").cast("array<float>")), path, "fvecs", mode)


def write_ivecs(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """vectors (vec_id, embedding) of integers as .ivecs parts, as write_fvecs() does."""
    _write_by_bytes(vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("vec_id", F.col("embedding").cast("array<int>")), path, "ivecs", mode)


def write_raw(values: DataFrame, path: str, kind: str, mode: str = "overwrite") -> None:
    """values (row, value) as parts of bare i32, i64 or f32 values in order of row."""
    _write_by_bytes(values.repartitionByRange("row").sortWithinPartitions("row").select("row", F.col("value").cast(RAW[kind][1])), path, kind, mode)


#: Element types of raw files.
RAW = {"i32": ("<i4", "int"), "i64": ("<i8", "long"), "f32": ("<f4", "float")}


def _values(spark: SparkSession, path: str, element: str, rows: int | None, parse) -> DataFrame:
    """(row, value) of a file of one array, which parse makes of its bytes; a count other than rows is an error. A file is one task's work, as the format has no index."""

    def of(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                x = parse(name, data)
                if rows is not None and len(x) != rows:
                    raise ValueError(f"{name}: {len(x)} values, not {rows}")
                for at in range(0, len(x), 1 << 16):
                    part = x[at : at + (1 << 16)]
                    yield pd.DataFrame({"row": np.arange(at, at + len(part)), "value": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(of, f"row long, value {element}")


def read_raw(spark: SparkSession, path: str, kind: str, rows: int | None = None) -> DataFrame:
    """(row, value) of files of little-endian i32, i64 or f32 values without a header, split by bytes; a part of a value, or a number of values other than rows, is an error."""
    if reaches(path):
        return _by_bytes(spark, path, kind, rows)
    dtype, element = RAW[kind]

    def parse(name, data):
        if len(data) % np.dtype(dtype).itemsize:
            raise ValueError(f"{name}: not a whole number of {kind} values")
        return np.frombuffer(data, dtype)

    return _values(spark, path, element, rows, parse)


def raw_bytes(values: list, kind: str) -> bytes:
    """Values as the bytes of a raw file."""
    return np.asarray(values, RAW[kind][0]).tobytes()


def read_npy(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """(row, value) of a .npy file of one dimension of 32-bit integers; other types, orders and shapes are errors."""

    def parse(name, data):
        x = np.load(io.BytesIO(data), allow_pickle=False)
        if x.dtype != np.dtype("<i4") or x.ndim != 1:
            raise ValueError(f"{name}: not one dimension of 32-bit integers")
        return x

    return _values(spark, path, "int", rows, parse)


def read_attribute(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """(row, value) of an attribute: .npy by its suffix, else raw 32-bit integers."""
    return read_npy(spark, path, rows) if path.endswith(".npy") else read_raw(spark, path, "i32", rows)


def fvecs_bytes(rows: list[list[float]]) -> bytes:
    """Vectors as the bytes of an .fvecs file."""
    m = np.asarray(rows, "<f4")
    return np.hstack([np.full((len(m), 1), m.shape[1] if m.ndim > 1 else 0, "<i4"), m.view("<i4")]).astype("<i4").tobytes() if len(m) else b""


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors as Parquet in ranges of vec_id, the layout that the readers of this library prefer."""
    vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.mode("overwrite").parquet(path)


def write_sorted_by_attribute(base: DataFrame, path: str, attr: str = "attr") -> None:
    """The secondary index: base in order of (attribute, vec_id), so that a literal range prunes row groups by their extremes."""
    base.repartitionByRange(attr, "vec_id").sortWithinPartitions(attr, "vec_id").write.mode("overwrite").parquet(path)


def write_cells(base: DataFrame, path: str, attr: str = "attr") -> None:
    """The probed table: a folder per cell, sorted by attribute inside. Cells are salted over files by vec_id, so a large one is not one task's work."""
    base.repartition("cluster_id", F.pmod(F.xxhash64("vec_id"), F.lit(16))).sortWithinPartitions("cluster_id", attr).write.mode("overwrite").partitionBy("cluster_id").parquet(path)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, lo, hi) of a text file with 'lo hi' or 'lo,hi' a line; # begins a comment, blank lines are passed over and reversed ends are turned."""
    text = F.trim(F.regexp_replace(F.translate(F.regexp_replace("value", "#.*$", ""), ",", " "), r"\s+", " "))
    lines = spark.read.text(path).select(text.alias("t"), F.monotonically_increasing_id().alias("line")).where("t <> ''")
    parts = F.split("t", " ")
    both = lines.select("line", parts[0].cast("int").alias("a"), parts[1].cast("int").alias("b"))
    return both.select((F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("query_id"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def write_ranges(queries: DataFrame, path: str) -> None:
    """'lo hi' a line in order of query_id."""
    queries.orderBy("query_id").select(F.concat_ws(" ", "lo", "hi").alias("value")).write.mode("overwrite").text(path)


#: What a manifest must name.
MANIFEST_FIELDS = ("version", "dimension", "num_vectors", "post_index", "pre_index", "base_vectors_file", "attr_file", "sorted_attr_file", "sorted_ids_file")


def read_manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value lines; missing fields are errors."""
    lines = spark.read.text(path).where("value like '%=%'").select(F.trim(F.substring_index("value", "=", 1)).alias("k"), F.trim(F.expr("substring(value, locate('=', value) + 1)")).alias("v"))
    out = {r.k: r.v for r in lines.limit(1001).collect()}
    if len(out) > 1000:
        raise ValueError("more than 1000 lines in a manifest")
    if missing := [f for f in MANIFEST_FIELDS if f not in out]:
        raise ValueError(f"manifest without {', '.join(missing)}")
    return out


def write_manifest(spark: SparkSession, fields: dict[str, str], path: str) -> None:
    if missing := [f for f in MANIFEST_FIELDS if f not in fields]:
        raise ValueError(f"manifest without {', '.join(missing)}")
    spark.createDataFrame([(f"{k}={v}",) for k, v in fields.items()], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_catalogues(spark: SparkSession, paths: list[str], most_rows: int | None = None) -> DataFrame:
    """The union of CSV files by column name, with source_file; files without rows are passed over. most_rows: rows of each file, all by default.

    Files are UTF-8, or Latin-1 where they are not valid UTF-8.
    """
    frames = []
    for p in sorted(paths):
        broken = spark.read.text(p).where(~F.is_valid_utf8("value")).limit(1).count()
        df = spark.read.csv(p, header=True, multiLine=True, escape='"', mode="PERMISSIVE", encoding="ISO-8859-1" if broken else "UTF-8")
        if most_rows is not None:
            df = df.limit(most_rows)
        if df.columns and df.limit(1).count():
            frames.append(df.withColumn("source_file", F.lit(p.rsplit("/", 1)[-1])))
    if not frames:
        raise ValueError("no rows in any file")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_comparison(spark: SparkSession, path: str, metrics: tuple[str, ...] = ("true_correlation", "heuristic_correlation", "tanh_correlation", "pgap_correlation")) -> DataFrame:
    """Labelled scores of a comparison CSV: lower-case class of the known three, finite numbers; missing columns are errors."""
    df = spark.read.csv(path, header=True)
    if missing := [c for c in ("correlation_type", *metrics) if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    out = df.withColumn("actual", F.lower(F.trim("correlation_type"))).where(F.col("actual").isin(*CLASSES))
    out = out.withColumns({m: F.col(m).try_cast("double") for m in metrics})
    return reduce(lambda d, m: d.where(finite(F.col(m))), metrics, out)


def read_tau_points(spark: SparkSession, root: str, metric: str) -> DataFrame:
    """(source, selectivity, tau, balanced_accuracy, macro_f1) of a metric from the summary CSVs below root; of files with equal selectivity the last by name."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_summary.csv").csv(root, header=True)
    df = df.where(F.col("metric") == metric).select(F.col("_metadata.file_path").alias("source"), selectivity_of_name(F.col("_metadata.file_name")).alias("selectivity"), *[F.col(c).try_cast("double").alias(c) for c in ("tau", "balanced_accuracy", "macro_f1")])
    df = df.where("selectivity is not null and tau is not null")
    r = F.row_number().over(Window.partitionBy("selectivity").orderBy(F.col("source").desc()))
    return df.withColumn("r", r).where("r = 1").drop("r")


def read_mixed_set(spark: SparkSession, path: str) -> DataFrame:
    """A stored workload, with what older ones lack filled in: backend by label, dataset and the wanted selectivity."""
    df = spark.read.parquet(path)
    defaults = {"dataset": F.lit("vectors"), "label": F.lit("random"), "target_selectivity": F.lit(None).cast("double")}
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    backend = F.when(F.col("label") == "random", F.lit("rand")).otherwise(F.lit("corr"))
    return df.withColumn("backend", F.coalesce(F.col("backend"), backend) if "backend" in df.columns else backend)


def write_mixed_set(queries: DataFrame, path: str) -> None:
    """A workload as Parquet in order of query_id, for read_mixed_set."""
    queries.repartitionByRange("query_id").sortWithinPartitions("query_id").write.mode("overwrite").parquet(path)


def numbered_folder(spark: SparkSession, root: str, prefix: str = "exp") -> str:
    """A new folder <root>/<prefix>N, with N one more than the largest that is there, from 1."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    taken = [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdecimal()]
    out = f"{root}/{prefix}{max(taken, default=0) + 1}"
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(out))
    return out


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    report.coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown(report: DataFrame, most_rows: int = 200) -> str:
    """A small report as a Markdown table."""
    rows = report.limit(most_rows).collect()
    show = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])
