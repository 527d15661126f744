import numpy as np
import pytest

from nearfield.llm import minhash
from nearfield.llm.minhash import banding, estimate, least_estimate, minima, near_duplicates, pack

from .fixtures import brute_components, documents, key, odd_docs


@pytest.mark.parametrize("make", [documents, odd_docs])
def test_as_brute_force(spark, make):
    docs = make(spark)
    expected = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = near_duplicates(docs).collect()
    assert key(got, "doc_id", "n_shingles", "component_id") == sorted(expected, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert near_duplicates(documents(spark).limit(0)).collect() == []


def test_near_copies_of_one_text(spark):
    """A group of copies with edits at several rates: components as all pairs give them."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for k in rng.choice(150, int(rng.integers(0, 12)), replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert key(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows))


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 700, dtype=np.uint64)
    sets = [np.concatenate([common[:n], rng.integers(0, 2**63, 700 - n, dtype=np.uint64)]) for n in (700, 0, 600)]
    p = pack(minima([common, *sets]))
    assert estimate(p[0], p[1]) == 1
    assert abs(estimate(p[0], p[2])) < 0.12
    assert abs(estimate(p[0], p[3]) - 600 / 800) < 0.15


def test_bands_and_margin_follow_the_threshold(spark):
    """A pair at the threshold misses all bands or the margin hardly ever, at whatever threshold."""
    for percent in (60, 80, 85, 95):
        bands, rows = banding(percent)
        s = percent / 100
        equal = s + (1 - s) / 16
        assert bands * rows <= 128 and (1 - s**rows) ** bands <= 5e-7
        assert s - least_estimate(percent) >= 5 * (equal * (1 - equal) / 128) ** 0.5 / (15 / 16)
    rows = []
    for i in range(40):
        w = [f"d{i}w{k}" for k in range(100)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:25], f"e{i}", *w[26:70], f"g{i}", *w[71:]]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert key(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, 80))


@pytest.mark.parametrize("far", [0, 40])
def test_hot_bands_and_classes(spark, monkeypatch, far):
    """Bands and classes of many blocks give the components of all pairs, whether members are near a hub, near each other alone, or far from all."""
    monkeypatch.setattr(minhash, "BAND_BLOCK", 8)
    monkeypatch.setattr(minhash, "CLASS_BLOCK", 6)
    monkeypatch.setattr(minhash, "CLASS_BLOCK_MOST", 12)
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(150):
        w = list(base)
        for k in rng.choice(150, int(rng.integers(0, 4 if i < 110 else 14)), replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    for i in range(far):  # a second group, which shares 60 % of the first's words
        w = base[:110] + [f"q{k}" for k in range(70)]
        w[int(rng.integers(180))] = f"f{i}"
        rows.append((1000 + i, " ".join(w)))
    rows += rows[3:6]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert key(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows))


def test_linked_to():
    hub = np.arange(10, 110, dtype=np.uint64)
    sets = [hub, hub[:85], hub[:84], np.array([5], np.uint64), np.array([500], np.uint64), np.concatenate([hub, np.arange(200, 217, dtype=np.uint64)])]
    assert minhash.linked_to(hub, sets, 85).tolist() == [True, True, False, False, False, True]
