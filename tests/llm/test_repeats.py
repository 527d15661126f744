import pytest
from pyspark.sql import functions as F

from nearfield.llm.repeats import repeat_spans, repeats, repeats_digest, without_repeats

from .fixtures import brute_repeats, documents, key, odd_docs


@pytest.mark.parametrize("make", [documents, odd_docs])
def test_as_brute_force(spark, make):
    docs = make(spark)
    expected = brute_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = repeats_digest(docs).collect()
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert key(got, *names) == key([dict(zip(names, e, strict=True)) for e in expected], *names)


def test_runs_of_one_word(spark):
    rows = [(i, "x " * n) for i, n in enumerate((1, 34, 35, 36, 50, 200))] + [(9, "y " * 35), (10, "z " * 36), (11, ("a b c " * 20))]
    got = repeats_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert key(got, *names) == sorted(brute_repeats(rows))


def test_spans_and_texts(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"{passage} d")], "doc_id long, text string")
    assert key(repeat_spans(docs).collect(), "doc_id", "first", "words") == [(1, 2, 40), (2, 0, 40)]
    assert key(without_repeats(docs).collect(), "doc_id", "text") == [(1, "a b c"), (2, "d")]


def test_empty_table(spark):
    assert repeats_digest(documents(spark).limit(0)).collect() == []


def test_many_equal_ids(spark):
    """2,000 rows without an id and as many with one id: each meets its own result, so no more rows are joined than there are."""
    passage = " ".join(f"p{i}" for i in range(36))
    rows = [(i % 2 * 7 or None, f"text {i} {passage if i % 10 < 2 else 'alone'} end{i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats(docs).count() == len(rows)
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert key(repeats_digest(docs).collect(), *names) == key([dict(zip(names, e, strict=True)) for e in brute_repeats(rows)], *names)
    joined = docs.join(repeats(docs).withColumnsRenamed({"doc_id": "id", "text_hash": "h"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("h")))
    assert joined.count() == len(rows)
