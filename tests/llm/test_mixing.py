from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm.mixing import drawn_slots, mixed_documents, mixture, permuted, source_targets, taken_words, with_sizes

from .fixtures import SPACE, documents, odd_docs


def brute_targets(sizes):
    """Targets by resharing the excess until none is above; sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        room = total - sum(fixed.values())
        share = {s: room * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("make", [documents, odd_docs])
def test_targets_and_taken(spark, make):
    docs = make(spark)
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(SPACE.findall(r.text or ""))
    target = brute_targets(sizes)
    sized = with_sizes(docs)
    got = taken_words(*mixture(sized)).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.03 * target[s], 200), s
    again = taken_words(*mixture(with_sizes(docs.repartition(3)))).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in got) == sorted((r.doc_id or 0, r.taken) for r in again)


def test_slots_are_dealt_once(spark):
    sized = with_sizes(documents(spark))
    t = source_targets(sized)
    slots = drawn_slots(t).collect()
    places = [(r.shard, r.place) for r in slots]
    assert len(set(places)) == len(places) == t.agg({"slots": "sum"}).first()[0]
    assert len({(r.s, r["pass"], r.block) for r in slots}) == len(slots)


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_documents_of_the_mix(spark):
    docs = documents(spark)
    text = {r.doc_id: r.text for r in docs.collect()}
    taken = {r.doc_id: r.taken for r in taken_words(*mixture(with_sizes(docs))).collect()}
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    words = {}
    for r in got.collect():
        own = SPACE.findall(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(own)
        assert set(own) <= set(SPACE.findall(text[r.doc_id]))
        assert r.n_chars == len(r.text)
    assert words == {k: v for k, v in taken.items() if v}


def test_empty_table(spark):
    assert taken_words(*mixture(with_sizes(documents(spark).limit(0)))).collect() == []
    assert mixed_documents(documents(spark).limit(0)).collect() == []


def test_counts_of_a_shard_are_multinomial(spark):
    """Over many shards the counts of a source vary as a multinomial draw's do, while the totals meet the targets."""
    sized = spark.createDataFrame([("a", 640_000), ("b", 640_000), ("c", 640_000), ("d", 64_000)], "source string, size long")
    targets = source_targets(sized)
    shards, slots = 64, {r.s: r.slots for r in targets.collect()}
    n = sum(slots.values())
    got = drawn_slots(targets, shard_slots=shards).collect()
    assert Counter(r.s for r in got) == slots
    counts = defaultdict(lambda: np.zeros(n // shards))
    for r in got:
        if r.shard < n // shards:
            counts[r.s][r.shard] += 1
    for s, c in counts.items():
        p = slots[s] / n
        assert abs(c.mean() - shards * p) < 4 * np.sqrt(shards * p / len(c))
        assert 0.8 < c.var() / (shards * p * (1 - p)) < 1.25, s
    a, b = counts[0], counts[1]
    assert np.corrcoef(a, b)[0, 1] < -0.3  # what one source has the others lack


def test_taken_as_brute_force(spark):
    """Each document's words, counted from the blocks that the slots name and from the stream that the documents make."""
    docs = documents(spark)
    laid, pieces = mixture(with_sizes(docs))
    rows = laid.collect()
    drawn = Counter((r.s, r.block) for r in drawn_slots(source_targets(with_sizes(docs))).collect())
    stream = {r.row: sum(drawn[r.s, w // 64] for w in range(r.start, r.start + r.size)) for r in rows}
    assert {r.row: r.taken for r in taken_words(laid, pieces).collect()} == stream
    for s in {r.s for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.s == s and r.size), key=lambda r: r.start):
            assert r.start == at  # no gap and no overlap
            at += r.size


def test_permutations_differ_and_spread(spark):
    n = 4096
    got = [[r.x for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(k)).alias("x")).collect()] for k in (1, 2)]
    for x in got:
        step = np.diff(np.array(x))
        assert len(np.unique(step)) > n / 2 and abs(np.corrcoef(x, np.arange(n))[0, 1]) < 0.1
    assert sum(a == b for a, b in zip(*got, strict=True)) < 20


def test_equal_ids_are_dealt_over_buckets(spark):
    docs = spark.createDataFrame([(None, f"text {i} of many words", "a") for i in range(3000)], "doc_id long, text string, source string")
    laid, _ = mixture(with_sizes(docs))
    assert sorted(r.start for r in laid.collect()) == [5 * i for i in range(3000)]
