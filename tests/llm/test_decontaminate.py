from collections import Counter

import pytest

from nearfield.llm.decontaminate import benchmark_windows, contamination, indexed, item_words, phrase_matches, proximity_matches, without_contaminated

from .fixtures import ALNUM, SF, brute_contamination, documents, key, lower, odd_docs

NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def odd_items(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "SAME text"), (2, None), (3, ""), (4, passage), (5, passage), (None, "null id has"), (6, "one"), (7, "a a a a a a a a a a a a"), (8, "nowhere to be found"), (10, "a"), (9, "école")]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 as win", "2 as doc_id")


@pytest.mark.parametrize("odd", [False, True])
def test_as_brute_force(spark, odd):
    docs, items = (odd_docs(spark), odd_items(spark)) if odd else (documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet"))
    expected = brute_contamination([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.select("item_id", "text").collect()])
    got = contamination(docs, items).collect()
    assert key(got, *NAMES) == key([dict(zip(NAMES, e, strict=True)) for e in expected], *NAMES)
    assert any(r.contaminated for r in got)
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not e[-1] for e in expected)


def test_empty_tables(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert contamination(docs.limit(0), items).collect() == []
    assert not any(r.contaminated for r in contamination(docs, items.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 50 + "beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert key(proximity_matches(docs, items, span=8).collect(), "doc_id", "item_id", "start") == [(1, 1, 0), (2, 1, 0)]


def brute_near(rows, items, span=30, rarest=3):
    """Number of items whose rarest terms stand near each other, by document."""
    texts = [[x.lower() for x in ALNUM.findall(lower(t))] for _, t in rows]
    count, out = Counter(x for w in texts for x in w), []
    chosen = []
    for _, t in items:
        own = [(count[x.lower()], k, x.lower()) for k, x in enumerate(dict.fromkeys(ALNUM.findall(lower(t))))]
        own = sorted(own)[:rarest]
        if own and own[0][0]:
            chosen.append({k: x for _, k, x in own})
    for (i, _), w in zip(rows, texts, strict=True):
        out.append((i, sum(any(set(c.values()) <= set(w[s : s + span]) for s in range(len(w))) for c in chosen if set(c.values()) <= set(w))))
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_near_as_brute_force(spark, odd):
    docs, items = (odd_docs(spark), odd_items(spark)) if odd else (documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet"))
    docs = docs.where("doc_id is null or doc_id not in (6, 7)") if odd else docs
    expected = brute_near([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.select("item_id", "text").collect()])
    got = contamination(docs, items, proximity=True).collect()
    assert key(got, "doc_id", "n_near") == key([dict(zip(("doc_id", "n_near"), e, strict=True)) for e in expected], "doc_id", "n_near")
    assert any(r.n_near for r in got)


def test_many_null_ids(spark):
    """Rows without an id are told apart by their texts: each is given its own matches, not those of all."""
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(None, f"number {i} {passage} end{i}" if i % 2 else f"number {i} is clean") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = contamination(docs, items)
    assert sorted(r.n_hit for r in got.collect()) == [0] * 1000 + [12] * 1000
    whole = item_words(items)
    found = phrase_matches(indexed(docs, whole), benchmark_windows(items)[0])
    assert found.count() == 1000 and found.agg({"found": "max"}).first() and max(len(r.found) for r in found.collect()) == 3
