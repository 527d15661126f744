import base64

import numpy as np
from pyspark.sql import functions as F

from nearfield.llm.language import fit, predict, remainder, without_rejected

from .fixtures import crc, documents, odd_docs


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", remainder(F.col("doc_id"), 4) == 2)
    model = fit(docs.where("not held"))
    rows = predict(docs.select("doc_id", "text", F.col("lang").alias("truth"), "held"), model).where("held").collect()
    assert rows and all((crc(r.doc_id) % 4 == 2) == r.held for r in rows)
    assert sum(r.lang_pred == r.truth for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) / len(rows) < 0.02


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = predict(docs, fit(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        silent = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == silent and r.rejected >= silent
        assert r.lang_pred in ("und", "en", "fr") and 0 <= r.score <= 1
    kept = without_rejected(docs)
    assert kept.columns == docs.columns
    assert {3, 4, 5, 13}.isdisjoint({r.doc_id for r in kept.collect()})


def test_short_clean_texts_stay(spark):
    docs = spark.createDataFrame([(1, "This."), (2, "A."), (3, "De.")], "doc_id long, text string")
    assert not any(r.rejected for r in predict(docs, fit(documents(spark))).collect())


def test_nothing_to_learn_from(spark):
    docs = documents(spark)
    assert fit(docs.limit(0)) is None
    assert {r.lang_pred for r in predict(docs, None).collect()} == {"und"}
    assert without_rejected(docs.limit(0)).collect() == []


def test_foreign_text_is_rejected(spark):
    docs = documents(spark)
    strange = spark.createDataFrame([(1, "Привет как дела сегодня хорошая погода и мы идём гулять в парк")], "doc_id long, text string")
    assert predict(strange, fit(docs)).first().rejected


FINNISH = """Suomen kieli kuuluu uralilaisten kielten itämerensuomalaiseen ryhmään ja sitä puhuu noin viisi miljoonaa ihmistä. Kesällä järvien rannoilla on hiljaista
ja valoisaa, ja monet perheet viettävät lomansa mökillä uiden, kalastaen ja saunoen. Talvella lumi peittää metsät ja päivät ovat lyhyitä, mutta ihmiset hiihtävät ja
luistelevat jäällä. Kaupungissa työt alkavat aikaisin aamulla ja lapset kävelevät kouluun pimeässä. Illalla keitetään kahvia ja luetaan kirjoja."""


def test_latin_junk_and_an_unseen_language_are_rejected(spark):
    """Beside test_held_out_accuracy, which holds how many clean texts are rejected."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = [(i, " ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(200))) for i in range(5)]
    rows += [(10 + i, base64.b64encode(rng.bytes(1125)).decode()) for i in range(5)]
    rows += [(20, FINNISH)]
    model = fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r.doc_id for r in got if not r.rejected] == []


def test_sample_is_bounded_whatever_the_ids(spark):
    texts = [r.text for r in documents(spark).where("lang = 'en' and text is not null").limit(50).collect()]
    rows = [(None, f"{texts[i % len(texts)]} {i}", "en") for i in range(3000)] + [(i, t, "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs, per_language=16)
    assert model is not None and {r.lang_pred for r in predict(docs.limit(20), model).collect()} == {"en"}


def brute_predict(model, text):
    """Nearest centroid by plain dictionaries of n-grams."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode())
    grams = {}
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            g = raw[i : i + n]
            if g.strip(b" "):
                h = (((int.from_bytes(g, "big") + n) * 0x9E3779B1) & 0xFFFFFFFF) >> 18
                grams[h] = grams.get(h, 0) + 1
    v = {h: np.log1p(c) * float(model.idf[h]) for h, c in grams.items()}
    size = np.sqrt(sum(x * x for x in v.values()))
    sims = [sum(x * float(c[h]) for h, x in v.items()) / size if size else 0 for c in model.centroids]
    best = int(np.argmax(sims))
    return model.languages[model.owner[best]], min(max(sims[best], 0), 1)


def test_predictions_as_brute_force(spark):
    docs = documents(spark)
    model = fit(docs)
    for r in predict(docs.select("doc_id", "text").limit(60), model).collect():
        if r.lang_pred != "und":
            lang, score = brute_predict(model, r.text)
            assert lang == r.lang_pred and abs(score - r.score) < 1e-4


def test_thousands_of_languages(spark):
    """Dirty values of lang teach nothing beyond the most frequent ones, and break nothing."""
    rows = [(i, "the cat sat on the mat with the other cats " * 3, f"x{i}") for i in range(3000)] + [(10_000 + i, "der Hund lag auf der Matte neben den anderen Hunden " * 3, "de") for i in range(40)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=5)
    assert len(model.languages) <= 5 and "de" in model.languages
    got = predict(spark.createDataFrame([(1, "auf der Matte lag der Hund")], "doc_id long, text string"), model).first()
    assert got.lang_pred == "de"
