import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import scalars
from nearfield.sources import files
from nearfield.streaming.routing import answer_stream


def test_fvecs(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(files.fvecs_bytes([[1.5, 2.0], [3.0, 4.0]]))
    (tmp_path / "b.fvecs").write_bytes(files.fvecs_bytes([[5.0, 6.0]]))
    got = sorted((r.vec_id, r.embedding) for r in files.read_fvecs(spark, str(tmp_path)).collect())
    assert got == [(0, [1.5, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])]
    (tmp_path / "c.fvecs").write_bytes(b"\x02\0\0\0\0\0")
    with pytest.raises(Exception, match="whole number"):
        files.read_fvecs(spark, str(tmp_path)).collect()


def test_ranges(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# ranges\n1 5\n\n9,2 # turned\n  3,  4\n")
    got = [(r.query_id, r.lo, r.hi) for r in files.read_ranges(spark, str(tmp_path / "r.txt")).orderBy("query_id").collect()]
    assert got == [(0, 1, 5), (1, 2, 9), (2, 3, 4)]
    files.write_ranges(files.read_ranges(spark, str(tmp_path / "r.txt")), str(tmp_path / "out"))
    assert files.read_ranges(spark, str(tmp_path / "out")).count() == 3


def test_manifest(spark, tmp_path):
    fields = {k: f"{k}=x" for k in files.MANIFEST_FIELDS}
    files.write_manifest(spark, fields, str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")) == fields
    with pytest.raises(ValueError):
        files.write_manifest(spark, {"version": "1"}, str(tmp_path / "n"))


def test_catalogues(spark, tmp_path):
    (tmp_path / "b.csv").write_text("title,price\nCup,2\n")
    (tmp_path / "a.csv").write_text("name,title\nx,Pan\ny,Pot\n")
    (tmp_path / "c.csv").write_text("title\n")
    got = files.read_catalogues(spark, [str(tmp_path / f) for f in ("b.csv", "a.csv", "c.csv")])
    assert {(r.title, r.source_file) for r in got.collect()} == {("Pan", "a.csv"), ("Pot", "a.csv"), ("Cup", "b.csv")}
    assert files.read_catalogues(spark, [str(tmp_path / "a.csv")], 1).count() == 1


def test_reports(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for token, tau in (("0p001", 0.1), ("0p01", 0.2)):
        (tmp_path / "x" / f"tau_{token}_summary.csv").write_text(f"metric,tau,accuracy,balanced_accuracy,macro_f1\ntrue,{tau},1,1,1\ntanh,9,1,1,1\n")
    assert sorted((r.selectivity, r.tau) for r in files.read_tau_points(spark, str(tmp_path), "true").collect()) == [(0.001, 0.1), (0.01, 0.2)]
    (tmp_path / "c.csv").write_text("correlation_type,true_correlation,heuristic_correlation,tanh_correlation,pgap_correlation\nPositive,1,2,3,4\nother,1,2,3,4\nrandom,x,2,3,4\n")
    assert [(r.actual, r.pgap_correlation) for r in files.read_comparison(spark, str(tmp_path / "c.csv")).collect()] == [("positive", 4.0)]
    assert files.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double")).splitlines()[-1] == "| 1 | 0.500000 |"


def test_mixed_set_defaults(spark, tmp_path):
    spark.createDataFrame([(1, "positive"), (2, None)], "query_id long, label string").write.parquet(str(tmp_path / "m"))
    got = sorted((r.query_id, r.label, r.backend, r.dataset) for r in files.read_mixed_set(spark, str(tmp_path / "m")).collect())
    assert got == [(1, "positive", "corr", "vectors"), (2, "random", "rand", "vectors")]


def test_stream(spark, tmp_path):
    q = spark.createDataFrame([(1, 0, 5), (2, 5, 9)], "query_id long, lo long, hi long")
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    run = answer_stream(stream, lambda b: b.selectExpr("query_id", "hi - lo as width"), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination(60)
    assert sorted((r.query_id, r.width) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 5), (2, 4)]


def test_arrays(spark, tmp_path):
    x = np.arange(-3, 5, dtype="<i4")
    np.save(tmp_path / "a.npy", x)
    (tmp_path / "a.bin").write_bytes(files.raw_bytes(x.tolist(), "i32"))
    for name in ("a.npy", "a.bin"):
        assert [r.value for r in files.read_attribute(spark, str(tmp_path / name), 8).orderBy("row").collect()] == x.tolist()
        with pytest.raises(Exception, match="not 7"):
            files.read_attribute(spark, str(tmp_path / name), 7).collect()
    for kind, values in (("i64", [1 << 40, -2]), ("f32", [0.5, -1.25])):
        (tmp_path / kind).write_bytes(files.raw_bytes(values, kind))
        assert [r.value for r in files.read_raw(spark, str(tmp_path / kind), kind).orderBy("row").collect()] == values
    (tmp_path / "bad").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole number"):
        files.read_raw(spark, str(tmp_path / "bad"), "i32").collect()
    np.save(tmp_path / "b.npy", x.astype("<i8"))
    with pytest.raises(Exception, match="32-bit"):
        files.read_npy(spark, str(tmp_path / "b.npy")).collect()


def test_encodings_folders_and_json(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("title\nCafé\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("title\nThé\n".encode())
    assert {r.title for r in files.read_catalogues(spark, [str(tmp_path / "l.csv"), str(tmp_path / "u.csv")]).collect()} == {"Café", "Thé"}
    assert [files.numbered_folder(spark, str(tmp_path / "runs")).rsplit("/", 1)[1] for _ in range(2)] == ["exp1", "exp2"]
    row = spark.createDataFrame([(1, " 0.5, x,,2 ")], "a long, s string").select(scalars.json_of(b=F.lit(True), a=F.col("a")).alias("j"), scalars.numbers_of(F.col("s")).alias("n")).first()
    assert row.j == '{"a":1,"b":true}' and row.n == [0.5, None, 2.0]
    q = spark.createDataFrame([(2, "random"), (1, "positive")], "query_id long, label string")
    files.write_mixed_set(q, str(tmp_path / "m"))
    assert {(r.query_id, r.backend) for r in files.read_mixed_set(spark, str(tmp_path / "m")).collect()} == {(1, "corr"), (2, "rand")}
