import corpus_pipeline
from nearfield.llm.mixing import mixture, taken_words, with_sizes

from .fixtures import SF, SPACE, brute_components, brute_contamination, documents, odd_docs


def test_stages_against_brute_force(spark):
    docs, seen = documents(spark), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id", "text").collect() if k else None
        out = stage(spark, docs, SF)
        rows = out.collect()
        seen.append(rows)
        if k < 4:
            assert out.columns == documents(spark).columns
        if k == 1:
            expected = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before], 80) if i == c}
            assert sorted(r.doc_id for r in rows) == sorted(expected)
        if k == 2:
            items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            clean = [i for i, *_, bad in brute_contamination([(r.doc_id, r.text) for r in before], [(r.item_id, r.text) for r in items]) if not bad]
            assert sorted(r.doc_id for r in rows) == sorted(clean) and len(clean) < len(before)
        if k == 3:
            taken = sum(r.taken for r in taken_words(*mixture(with_sizes(docs))).collect())
            assert sum(len(SPACE.findall(r.text)) for r in rows) == taken
        docs = spark.createDataFrame(rows, out.schema)
    last = sorted(seen[4], key=lambda r: r.start)
    assert len(last) == len(seen[3])
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(last, last[1:], strict=False))


def test_run_and_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_rows_and_empty_tables(spark):
    for docs in (odd_docs(spark), documents(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_leave_each_other_alone(spark):
    """Results of earlier calls can be read after later ones, whatever these read."""
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        one, two = stage(spark, docs.where("doc_id % 2 = 0"), SF), stage(spark, docs.where("doc_id % 2 = 1"), SF)
        n = two.count()
        assert one.count() > 0 and one.where("doc_id % 2 = 1").count() == 0 and two.count() == n > 0


def test_near_duplicates_of_one_id_are_judged_by_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "x"), (7, b + " end", "z"), (None, a, "x"), (8, None, "x"), (8, "", "x"), (8, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'k' as kept_id", "1 as nth", "2 as text_hash", "3 as whole_row", "4 as key", "'' as lang", "0L as n_chars")
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns and out.where("kept_id = 'k' and nth = 1 and text_hash = 2 and whole_row = 3 and key = 4").count() == out.count()
    got = sorted(((r.doc_id, (r.text or "")[:2], r.source) for r in out.collect()), key=str)
    assert got == sorted([(3, "a0", "x"), (5, "b0", "x"), (None, "a0", "x"), (8, "", "x"), (8, "", "x")], key=str)
    assert corpus_pipeline.decontaminated(spark, docs, SF).count() == len(rows)
