import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.sources import files
from nearfield.sources.vecfiles import Part, VectorFiles, VectorReader, VectorWriter, Written


def test_a_file_is_many_tasks(spark, tmp_path):
    x = np.arange(5000 * 3, dtype=np.float32).reshape(-1, 3)
    (tmp_path / "a.fvecs").write_bytes(files.fvecs_bytes(x[:4000].tolist()))
    (tmp_path / "b.fvecs").write_bytes(files.fvecs_bytes(x[4000:].tolist()))
    (tmp_path / "_note").write_text("no vectors")
    files.read_fvecs(spark, str(tmp_path))
    df = spark.read.format("vecfiles").option("path", str(tmp_path)).option("splitBytes", "1000").load()
    assert df.rdd.getNumPartitions() == -(-4000 // 62) + -(-1000 // 62)
    got = df.orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == list(range(5000)) and np.array_equal(np.array([r.embedding for r in got], np.float32), x)


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_round_trips_from_many_partitions(spark, tmp_path, many_parts):
    v = spark.range(1000).select((F.col("id") * 7 % 1000).alias("vec_id")).withColumn("embedding", F.array((F.col("vec_id") / 3).cast("float"), F.lit(2.5).cast("float"))).repartition(7)
    path = str(tmp_path / "v")
    files.write_fvecs(v, path)
    files.write_fvecs(v, path)  # in place of what was there
    assert {(r.vec_id, tuple(r.embedding)) for r in files.read_fvecs(spark, path).collect()} == {(r.vec_id, tuple(r.embedding)) for r in v.collect()}
    assert open(f"{path}/_rows").read() == "1000" and len([f for f in os.listdir(path) if f.endswith(".fvecs")]) > 1 and not [f for f in os.listdir(path) if f.startswith(".part")]
    files.write_fvecs(v.where("vec_id < 10"), path, "append")
    assert open(f"{path}/_rows").read() == "1010" and files.read_fvecs(spark, path).count() == 1010
    i = v.select("vec_id", F.array(F.col("vec_id").cast("int"), F.lit(-1)).alias("embedding"))
    files.write_ivecs(i, str(tmp_path / "i"))
    assert [tuple(r.embedding) for r in files.read_ivecs(spark, str(tmp_path / "i")).orderBy("vec_id").limit(3).collect()] == [(0, -1), (1, -1), (2, -1)]
    for kind, values in (("i32", [3, -2, 7]), ("i64", [2**40, -1, 0]), ("f32", [0.5, -1.25, 3.0])):
        rows = spark.createDataFrame(list(enumerate(values)), f"row long, value {files.RAW[kind][1]}")
        files.write_raw(rows, str(tmp_path / kind), kind)
        assert [r.value for r in files.read_raw(spark, str(tmp_path / kind), kind, 3).orderBy("row").collect()] == values


def test_wrong_files_and_rows(spark, tmp_path):
    good = files.fvecs_bytes([[1.0, 2.0], [3.0, 4.0]])
    (tmp_path / "bad.fvecs").write_bytes(good[:12] + b"\x01" + good[13:])
    with pytest.raises(Exception, match="different lengths"):
        files.read_fvecs(spark, str(tmp_path / "bad.fvecs")).collect()
    with pytest.raises(Exception, match="3 values, not 4"):
        (tmp_path / "x").write_bytes(files.raw_bytes([1, 2, 3], "i32"))
        files.read_raw(spark, str(tmp_path / "x"), "i32", 4).collect()
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    kept = str(tmp_path / "kept")
    files.write_fvecs(ragged.limit(1), kept)
    with pytest.raises(Exception, match="one length|different lengths"):
        files.write_fvecs(ragged, kept)
    assert files.read_fvecs(spark, kept).count() == 1 and not [f for f in os.listdir(kept) if f.startswith(".part")]
    files.write_fvecs(ragged.limit(0), str(tmp_path / "none"))
    assert files.read_fvecs(spark, str(tmp_path / "none")).count() == 0


def test_driver_side(tmp_path):
    """What the driver does by itself: parts by bytes, and no commit of different lengths."""
    (tmp_path / "a.ivecs").write_bytes(files.fvecs_bytes([[1.0]] * 10))
    options = {"path": str(tmp_path), "kind": "ivecs", "splitbytes": "24"}
    parts = VectorReader(options).partitions()
    assert [(p.at, p.rows, p.first, p.width) for p in parts] == [(24 * k, 3 if k < 3 else 1, 3 * k, 1) for k in range(4)] and isinstance(parts[0], Part)
    assert VectorFiles({"kind": "i64"}).schema() == "row long, value long"
    with pytest.raises(ValueError):
        VectorWriter(options, False).commit([Written("a", "b", 1, 2), Written("c", "d", 1, 3)])
