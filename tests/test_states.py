import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import workload
from nearfield.operators.search import SearchOptions
from nearfield.plans import states


def test_mixed_workload_over_backends(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 4)) + rng.integers(0, 3, (160, 1)) * 6
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>")
    both = {b: states.State(s.base.cache(), s.cells) for b, s in states.vector_states(vectors, k=4).items()}
    assert set(both) == {"corr", "rand"}
    q = vectors.where("vec_id < 9").selectExpr("vec_id as query_id", "vec as qvec")
    labelled = workload.mixed_set(q, 9).select("query_id", "backend")
    q = q.join(labelled, "query_id").withColumn("lo", F.lit(100).cast("long")).withColumn("hi", F.lit(800).cast("long"))
    got = states.planned_answers(q, both, SearchOptions(k=3), 4).select("query_id", "vec_id", "backend")
    truth = states.exact_answers(q, both, 3).select("query_id", "vec_id", "backend")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, truth.collect()))


def test_catalogue_state_and_kept_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0], None if i == 5 else i / 10) for i in range(80)], "vec_id long, vec array<double>, price double")
    state = states.product_state(rows.select("vec_id", "price"), rows.select("vec_id", "vec"), "price")
    got = {r.vec_id: r.attr for r in state.base.collect()}
    assert len(got) == 79 and got[12] == 120 and 5 not in got
    rest, q = states.product_workload(state, 0.3, 0.2, 500)
    asked = {r.query_id for r in q.collect()}
    assert asked and asked.isdisjoint({r.vec_id for r in rest.base.collect()})
    made = []
    for _ in range(2):
        t = states.kept(spark, str(tmp_path), "k1", lambda: (made.append(1), rows)[1])
        assert t.count() == 80
    assert made == [1]


def test_tables_are_read_only_when_published(spark, tmp_path):
    rows = spark.range(5)
    # a write that broke off: files without a manifest
    rows.write.parquet(str(tmp_path / "k-broken"))
    (tmp_path / "k-broken" / "_SUCCESS").unlink()

    def fails():
        raise RuntimeError("no table")

    with pytest.raises(RuntimeError):
        states.kept(spark, str(tmp_path), "k", fails)
    assert states.kept(spark, str(tmp_path), "k", lambda: rows).count() == 5
    assert states.kept(spark, str(tmp_path), "k", fails).count() == 5

    def late():
        """Another writer publishes while this one writes."""
        states.kept(spark, str(tmp_path), "m", lambda: spark.range(7))
        return spark.range(9)

    assert states.kept(spark, str(tmp_path), "m", late).count() == 7
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("m-")]) == 1
    (tmp_path / "n.json").write_text("{")
    (tmp_path / ".n.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="names no table"):
        states.kept(spark, str(tmp_path), "n", lambda: rows)
