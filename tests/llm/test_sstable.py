
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearfield.llm import sstable
from nearfield.llm.sstable import END_ID, TableReader, TableWriter, encoder, key_of, lookup_tokens, read_digests, read_tokens, write_tokens

from .fixtures import documents, key, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("make", [documents, odd_docs])
def test_round_trip(spark, make):
    docs = make(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    tok, expected, start = Tokenizer.from_file(PATH), [], 0
    for i, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, END_ID]
        expected.append({"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    manifest = write_tokens(docs, PATH)
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert key(read_digests(manifest).collect(), *names) == key(expected, *names)
    whole = {(r.doc_id, r.start): r.ids for r in read_tokens(manifest).collect()}
    assert {k: len(v) for k, v in whole.items()} == {(e["doc_id"], e["start"]): e["n_tokens"] for e in expected}
    wanted = spark.createDataFrame([(i,) for i in (1, 3, 14, 150, 10**9, -5)], "doc_id long")
    got = lookup_tokens(manifest, wanted).collect()
    there = [r for r in expected if r["doc_id"] in (1, 3, 14, 150)]
    assert sorted((r.doc_id, len(r.ids)) for r in got) == sorted((r["doc_id"], r["n_tokens"]) for r in there)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_word_by_word_is_the_whole_text(texts):
    tok = Tokenizer.from_file(PATH)
    got = encoder(PATH)(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_and_bloom(tmp_path):
    path = tmp_path / "t.sst"
    with path.open("wb") as out:
        w = TableWriter(out, 2)
        for i in range(-3000, 3000, 3):
            w.add(key_of(i), np.arange(abs(i) % 50, dtype="<u2").tobytes())
        with pytest.raises(ValueError):
            w.add(key_of(0), b"")
        w.close()
    t = TableReader(f"file://{path}")
    assert len(t.where) > 1
    assert t.get(-3000)[0].tolist() == list(range(0)) and t.get(2997)[0].tolist() == list(range(47))
    assert t.get(1) == [] and t.get(10**6) == []
    assert sum(t.may_hold(key_of(i)) for i in range(10**6, 10**6 + 2000)) < 60
    assert [i for i, _ in t.scan()] == list(range(-3000, 3000, 3))
    data = bytearray(path.read_bytes())
    data[-100] ^= 1
    path.write_bytes(data)
    with pytest.raises(OSError):
        TableReader(f"file://{path}")


def test_empty_table(spark):
    manifest = write_tokens(documents(spark).limit(0), PATH)
    assert read_digests(manifest).collect() == []


def test_many_rows_of_one_id(spark, monkeypatch):
    """Rows without an id and rows of one id go over several shards; starts follow and all rows are found."""
    monkeypatch.setattr(sstable, "SHARD_CHARS", 4000)
    rows = [(i % 2 * 7 or None, f"text number {i} of many") for i in range(2000)] + [(9, "alone")]
    manifest = write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    sizes = [r.docs for r in manifest.collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 5 and max(sizes) < 1000
    at = 0
    for r in sorted(read_digests(manifest).collect(), key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    got = lookup_tokens(manifest, spark.createDataFrame([(7,), (9,), (8,)], "doc_id long")).collect()
    assert [sum(r.doc_id == i for r in got) for i in (7, 8, 9)] == [1000, 0, 1]


def test_tokenizers_that_look_across_white_space_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok, texts = encoder(path), Tokenizer.from_file(path), ["two  words\nhere", "", " lead", "x"]
    assert not enc.by_word and encoder(PATH).by_word
    assert [x.tolist() for x in enc(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
