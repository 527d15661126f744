"""Language identification by nearest centroid: normalised TF-IDF vectors of byte n-grams against several centroids a language, with rejection by distance."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import give_back, pieces, utf8

#: Features: hashed 2-, 3- and 4-grams of bytes.
FEATURES, GRAMS = 1 << 14, (2, 3, 4)
#: The classifier is fitted on a sample of about this many labelled documents a language, and this many in all languages together.
SAMPLE_PER_LANGUAGE, SAMPLE = 512, 16384
#: Languages that a model learns at most, the most frequent values of lang.
LANGUAGES = 128
CENTROIDS, ROUNDS = 4, 12
#: One in so many of the sample is held out of the centroids. A text is rejected if its similarity is below this share of what all but one in a hundred of
#: the held-out texts of about its length have; to have many of each length, they are also cut after so many characters.
HELD_OUT, REJECT = 4, 0.85
LENGTHS = (30, 60, 120, 250, 500, 1000, 2000, 4000)
#: Held-out texts that a length band needs; bands are powers of two of the number of n-grams.
BAND_TEXTS = 8
UNKNOWN = "und"
#: Fewer n-grams than this say less, and the least similarity shrinks in proportion: a text of a word or two is not unlike a language.
REJECT_GRAMS = 120
#: Rows of the dense matrix that a task holds at once.
DENSE_ROWS = 128


def _bytes_of_letters() -> np.ndarray:
    t = np.full(256, 0x20, np.uint8)
    for c in range(97, 123):
        t[c] = c
        t[c - 32] = c
    t[128:] = np.arange(128, 256)
    return t


_LETTERS = _bytes_of_letters()


def counts(texts: pa.Array) -> np.ndarray:
    """(len(texts), FEATURES) counts of hashed n-grams of whole texts; marks, digits and spaces are alike and grams of them alone don't count."""
    raw, off = utf8(texts)
    b = _LETTERS[raw].astype(np.uint32)
    n, doc = len(off) - 1, np.repeat(np.arange(len(off) - 1), np.diff(off))
    out = np.zeros(n * FEATURES, np.float32)
    shift = np.uint32(32 - int(math.log2(FEATURES)))
    for g in GRAMS:
        if len(b) < g:
            continue
        code = np.zeros(len(b) - g + 1, np.uint32)
        for k in range(g):
            code = (code << np.uint32(8)) | b[k : len(b) - g + 1 + k]
        inside = (doc[: len(code)] == doc[g - 1 :]) & (code != np.uint32(int.from_bytes(b"\x20" * g, "big")))
        h = ((code + np.uint32(g)) * np.uint32(0x9E3779B1)) >> shift
        out += np.bincount(doc[: len(code)][inside] * FEATURES + h[inside], minlength=len(out)).astype(np.float32)
    return out.reshape(n, FEATURES)


def has_letters(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(texts, r"\p{L}").fill_null(False))


@dataclass(frozen=True)
class LanguageModel:
    """Centroids (of unit length), their languages, weights of the features, and least similarities at numbers of n-grams; of bounded size."""

    languages: tuple[str, ...]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    grams: np.ndarray
    least: np.ndarray

    def vectors(self, c: np.ndarray) -> np.ndarray:
        v = np.log1p(c) * self.idf
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=n > 0)

    def predict(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and similarity to its nearest centroid, for rows of counts."""
        sim = self.vectors(c) @ self.centroids.T
        best = sim.argmax(axis=1)
        return self.owner[best], np.clip(sim[np.arange(len(sim)), best], 0, 1)

    def limit(self, c: np.ndarray) -> np.ndarray:
        """Similarity below which rows of counts are rejected."""
        grams = c.sum(axis=1)
        return REJECT * np.interp(np.log2(np.maximum(grams, 1)), self.grams, self.least) * np.minimum(1, grams / REJECT_GRAMS)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of unit rows by cosine; starts are rows far from those before."""
    k = min(k, len(x))
    at = [int((x @ x.mean(axis=0)).argmax())]
    while len(at) < k:
        at.append(int((x @ x[at].T).max(axis=1).argmin()))
    c = x[at]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([m / max(np.linalg.norm(m), 1e-9) for m in (x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k))])
    return c.astype(np.float32)


def _vector_rows(batches):
    """Sparse counts of whole texts, and of held-out ones cut at LENGTHS too."""
    for whole in pieces(batches, "text", 1 << 20):
        for at in range(0, whole.num_rows, DENSE_ROWS):
            b = whole.slice(at, DENSE_ROWS)
            long = pc.utf8_length(b.column("text"))
            parts = [(b, b.column("text"))]
            for n in LENGTHS:
                some = b.filter(pc.and_(b.column("held"), pc.greater(long, n)))
                parts.append((some, pc.utf8_slice_codeunits(some.column("text"), 0, n)))
            for rows, texts in parts:
                c, keep = counts(texts), np.flatnonzero(has_letters(texts))
                at_ = [np.flatnonzero(c[i]) for i in keep]
                take = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("lang").take(take), rows.column("held").take(take), pa.array([x.astype(np.uint16).tobytes() for x in at_], pa.binary()), pa.array([c[i, x].tobytes() for i, x in zip(keep, at_, strict=True)], pa.binary())], ["lang", "held", "at", "counts"])


def _dense(rows: list) -> np.ndarray:
    out = np.zeros((len(rows), FEATURES), np.float32)
    for k, r in enumerate(rows):
        out[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["counts"], np.float32)
    return out


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, languages: int = LANGUAGES) -> LanguageModel | None:
    """Fit on labelled rows of docs (doc_id, text, lang): a sample by a hash of doc_id, or of the text where that is null, of about per_language rows a language. None if there are none.

    Rows with a null text or lang, or without letters, teach nothing, nor do those of other than the languages most frequent values of lang (ties by name), which bound the model. Rows with the same doc_id are in the sample together, but never more than twice per_language.
    """
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    per = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()  # a row per language
    if not per:
        return None
    want, key = max(8, min(per_language, SAMPLE // len(per))), F.coalesce("doc_id", F.xxhash64("text"))
    share = [(r["lang"], int(min(1.0, want / r["n"]) * (1 << 30))) for r in per]
    share = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, share long"))
    picked = docs.join(share, "lang").where(F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1 << 30)) < F.col("share"))
    # rows of one id are in it together; twice the wanted number is far beyond what chance gives else
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "doc_id"))
    picked = picked.withColumn("nth", nth).where(F.col("nth") <= 2 * want)
    picked = picked.select("lang", "text", (F.pmod(F.xxhash64(key, F.lit("held")), F.lit(HELD_OUT)) == 0).alias("held"))
    got = picked.mapInArrow(_vector_rows, "lang string, held boolean, at binary, counts binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["at"], r["counts"]))
    names = tuple(sorted({r["lang"] for r in got}))
    taught = {r["lang"] for r in got if not r["held"]}
    learn, held = [r for r in got if not r["held"] or r["lang"] not in taught], [r for r in got if r["held"]]
    texts = np.zeros(FEATURES, np.int64)
    for r in learn:
        texts[np.frombuffer(r["at"], np.uint16)] += 1
    idf = (np.log((1 + len(learn)) / (1 + texts)) + 1).astype(np.float32)
    parts = []
    for name in names:  # one language's matrix at a time
        x = _dense([r for r in learn if r["lang"] == name])
        np.log1p(x, out=x)
        x *= idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        parts.append(_clusters(x, CENTROIDS))
        del x
    model = LanguageModel(names, np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts), idf, np.zeros(1), np.zeros(1))
    size, sim = [], []
    for at in range(0, len(held), DENSE_ROWS):
        c = _dense(held[at : at + DENSE_ROWS])
        size.append(np.log2(np.maximum(c.sum(axis=1), 1)))
        sim.append(model.predict(c)[1])
    del got, learn, held
    give_back()
    if not size:  # too few texts to hold one out
        return model
    size, sim = np.concatenate(size), np.concatenate(sim)
    bands = [size.astype(int) == k for k in range(int(size.max()) + 1)]
    points = [(size[b].mean(), np.quantile(sim[b], 0.01)) for b in bands if b.sum() >= BAND_TEXTS] or [(0.0, sim.min())]
    return LanguageModel(names, model.owner, model.centroids, idf, np.array([p[0] for p in points]), np.array([p[1] for p in points]))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang_pred, score (0 to 1, the similarity to the nearest centroid) and rejected (boolean), from text alone.

    A text that is null or has no letters is 'und' with score 0 and is rejected, as all are without a model. rejected does not change lang_pred.
    Further columns are kept; ones of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns

    def of(batches):
        for b in pieces(batches, "text", 1 << 21):
            for at in range(0, b.num_rows, DENSE_ROWS):
                part = b.slice(at, DENSE_ROWS)
                texts = part.column("text")
                known = has_letters(texts)
                lang, score, out = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
                if model is not None and known.any():
                    c = counts(texts)
                    which, sim = model.predict(c)
                    lang[known] = np.array(model.languages, object)[which[known]]
                    score[known] = sim[known]
                    out[known] = (sim < model.limit(c))[known]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out)], [*names, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(of, f"{fields}, lang_pred string, score double, rejected boolean")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def without_rejected(docs: DataFrame) -> DataFrame:
    """The documents whose language the model, fitted on all that are labelled, doesn't reject; columns as they are, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*[c if c == "text" else f"column_{i}" for i, c in enumerate(names)])
    kept = predict(plain, fit(docs)).where("not rejected")
    return kept.drop("lang_pred", "score", "rejected").toDF(*names)
