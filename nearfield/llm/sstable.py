"""Token-id shards as sorted string tables, written by the executors in parallel and read back by key or whole.

A shard holds the documents of one range of doc_id in ascending order. Its parts:

* data blocks: entries of (shared prefix length, suffix length, value length, key suffix, value); the first entry of a block has its whole key, so
  a block is read without its neighbours. A value is the document's ids, little-endian, 2 or 4 bytes each.
* block index: the first key, position and length of every block, for a binary search.
* Bloom filter over the keys.
* footer of fixed length: positions of index and filter, numbers of documents and tokens, width of an id, checksum of index and filter, magic.

Keys are 9 bytes that sort as doc_ids do: a null doc_id (0), then 1 and the big-endian id with its sign turned. Repeated doc_ids are entries side by side.
A shard's file is written under a name of its own for each attempt and counts only once the manifest names it, so a task that is tried again does no harm.
"""

from __future__ import annotations

import bisect
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import cut, new_path, pieces, words_of

BLOCK_BYTES = 64 << 10
#: Text that a shard holds, about, in characters.
SHARD_CHARS = 16 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"NFSST001"
FOOTER = struct.Struct("<QIQIQQIII8s")
END_ID = 2
#: Words whose ids a worker remembers.
MEMO_WORDS = 1 << 21

MANIFEST = "shard int, path string, docs long, tokens long, first long, last long, bytes long"


# ---------------------------------------------------------------- encoding


class Encoder:
    """Encodes whole texts with a public tokenizer word by word, each distinct word once.

    That is right only for tokenizers in which no token spans white space and nothing looks across it: those that drop white space before their merges. A tokenizer
    that doesn't encode PROBE so is given whole texts instead.
    """

    PROBE = "ab  cd\n\tAb 12 x1, y.\r\nf\u00fcr \u4e2d\u6587 ' s"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        whole, *each = [e.ids for e in self.tokenizer.encode_batch([self.PROBE, *self.PROBE.split()], add_special_tokens=False)]
        self.by_word = whole == [i for ids in each for i in ids]
        self.forget()

    def forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.uint32)]
        self.total, self.flat = 0, np.zeros(0, np.uint32)

    def places(self, w, codes: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """Where the ids of the distinct words lie in self.flat."""
        if len(self.keys) + len(distinct) > MEMO_WORDS:
            self.forget()
        p = np.searchsorted(self.keys, distinct)
        known = p < len(self.keys)
        known[known] = self.keys[p[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            where = np.empty(len(distinct), np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            got = [e.ids for e in encode([w.text(i).decode("utf-8", "replace") for i in where[new].tolist()], add_special_tokens=False)]
            size = np.array([len(x) for x in got], np.int64)
            self.first = np.concatenate([self.first, self.total + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))])
            self.total = len(self.flat)
            keys = np.concatenate([self.keys, distinct[new]])
            at = np.concatenate([self.at, np.arange(len(self.first) - len(new), len(self.first))])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at = keys[order], at[order]
            p = np.searchsorted(self.keys, distinct)
        return self.at[p]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        w = words_of(texts, lower=False)
        codes, distinct = pd.factorize(w.hash)
        place = self.places(w, codes, distinct)[codes] if len(codes) else np.zeros(0, np.int64)
        size = self.size[place]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.first[place] - (ends - size), size) + np.arange(int(size.sum()))]
        cuts = np.concatenate([[0], ends])[w.first]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- the file format


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b + i * i) % bits for i in range(BLOOM_HASHES)]


class TableWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at = out, width, 0
        self.block, self.first_key, self.last_key = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last_key:
            raise ValueError("keys out of order")
        if len(self.block) >= BLOCK_BYTES:
            self._flush()
        shared = 0
        if self.block:
            shared = len(os.path.commonprefix([key, self.last_key]))
        else:
            self.first_key = key
        self.block += bytes([shared, len(key) - shared]) + _varint(len(value)) + key[shared:] + value
        self.keys.append(key)
        self.last_key = key
        self.tokens += len(value) // self.width

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first_key, self.at, len(self.block)))
            self._write(bytes(self.block))
            self.block = bytearray()

    def close(self) -> int:
        self._flush()
        index = b"".join(bytes([len(k)]) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        where = self.at
        self._write(index)
        self._write(packed)
        self._write(FOOTER.pack(where, len(index), where + len(index), len(packed), len(self.keys), self.tokens, self.width, zlib.crc32(index + packed), bits, MAGIC))
        return self.at


def entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of each entry of a data block."""
    i, key = 0, b""
    while i < len(block):
        shared, own = block[i], block[i + 1]
        i, n, shift = i + 2, 0, 0
        while True:
            b = block[i]
            n, shift, i = n | (b & 127) << shift, shift + 7, i + 1
            if b < 128:
                break
        key = key[:shared] + block[i : i + own]
        i += own
        yield key, block[i : i + n]
        i += n


class TableReader:
    """One shard: whole scans, and lookups by Bloom filter and binary search."""

    def __init__(self, path: str) -> None:
        fs, where = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(where)
        size = self.file.size()
        i_at, i_n, b_at, b_n, self.docs, self.tokens, self.width, crc, self.bits, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        index, self.bloom = self.file.read_at(i_n, i_at), self.file.read_at(b_n, b_at)
        if magic != MAGIC or zlib.crc32(index + self.bloom) != crc:
            raise OSError(f"{path} is no whole shard")
        self.first, self.where, i = [], [], 0
        while i < len(index):
            n = index[i]
            self.first.append(index[i + 1 : i + 1 + n])
            self.where.append(struct.unpack_from("<QI", index, i + 1 + n))
            i += 13 + n

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def block(self, i: int) -> bytes:
        at, n = self.where[i]
        return self.file.read_at(n, at)

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.where)):
            for key, value in entries(self.block(i)):
                yield id_of(key), self._ids(value)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this doc_id."""
        key, out = key_of(doc_id), []
        if self.may_hold(key):
            i = max(0, bisect.bisect_left(self.first, key) - 1)
            while i < len(self.first) and self.first[i] <= key:
                out += [self._ids(v) for k, v in entries(self.block(i)) if k == key]
                i += 1
        return out

    def close(self) -> None:
        self.file.close()


# ---------------------------------------------------------------- Spark jobs


def _uri(path: str) -> str:
    return path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:/") else f"file://{path}"


def write_tokens(docs: DataFrame, tokenizer: str, out_dir: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode every text of docs (doc_id, text) and write the shards; the manifest, a row per shard in ascending ranges of doc_id.

    A null or empty text is its end id alone; a null doc_id sorts first; repeated doc_ids stay side by side, in order of a hash of their texts, by which many are
    dealt over several shards; no documents make no shard.
    tokenizer: path of a tokenizers file, there on every executor. out_dir: a folder that all executors share, by default in the scratch folder.
    """
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(chars / SHARD_CHARS))
    folder = _uri(f"{out_dir}/tokens-{uuid.uuid4().hex}" if out_dir else new_path(docs.sparkSession, "tokens"))

    def write(batches):
        enc, writer, out, first, last, path = encoder(tokenizer), None, None, None, None, ""
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        kind = "<u2" if enc.width == 2 else "<u4"
        for b in pieces(batches, "text", 8 << 20):
            if writer is None:
                path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}.sst"
                fs, where = pafs.FileSystem.from_uri(path)
                fs.create_dir(os.path.dirname(where), recursive=True)
                out = fs.open_output_stream(where)
                writer, first = TableWriter(out, enc.width), b.column("doc_id")[0].as_py()
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc(b.column("text")), strict=True):
                writer.add(key_of(doc_id), np.concatenate([ids, end]).astype(kind).tobytes())
                last = doc_id
        if writer is not None:
            size = writer.close()
            out.close()
            row = {"shard": shard, "path": path, "docs": len(writer.keys), "tokens": writer.tokens, "first": first, "last": last, "bytes": size}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("bytes", pa.int64())]))

    ordered = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return cut(ordered.mapInArrow(write, MANIFEST), "manifest")


def _with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest (a row per shard) with the number of ids before each shard."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(w), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<int>) of every document, read from the shards."""

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                for rows in _chunks(_scan(path, start)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].view(np.int32) for r in rows], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return _dealt(manifest).mapInArrow(read, "doc_id long, start long, ids array<int>")


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards; the checksum is over the ids as little-endian 32-bit integers."""

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                for rows in _chunks((i, s, len(ids), zlib.crc32(ids.tobytes())) for i, s, ids in _scan(path, start)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _dealt(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _dealt(manifest: DataFrame) -> DataFrame:
    n = max(1, manifest.count())
    return _with_starts(manifest).select("path", "start").repartition(n)


def _scan(path: str, start: int):
    t = TableReader(path)
    for doc_id, ids in t.scan():
        yield doc_id, start, ids
        start += len(ids)
    t.close()


def _chunks(rows, most: int = 2048):
    out = []
    for r in rows:
        out.append(r)
        if len(out) == most:
            yield out
            out = []
    if out:
        yield out


def lookup_tokens(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>) of the documents whose doc_id is in keys (doc_id), by Bloom filter and binary search in their shards."""
    bounds = sorted((r.shard, r.path, r.first, r.last) for r in manifest.select("shard", "path", "first", "last").collect())  # a row per shard
    low, high = (np.array([-(1 << 63) if b[i] is None else b[i] for b in bounds], np.int64) for i in (2, 3))

    def read(batches):
        tables: dict[str, TableReader] = {}
        for b in batches:
            rows = []
            for doc_id in b.column("doc_id").to_pylist():
                value = -(1 << 63) if doc_id is None else doc_id
                at = int(np.searchsorted(low, value, "right")) - 1
                while at >= 0 and high[at] >= value:  # an id's rows may go over several shards
                    path = bounds[at][1]
                    at -= 1
                    if path not in tables:
                        if len(tables) >= 16:
                            tables.pop(next(iter(tables))).close()
                        tables[path] = TableReader(path)
                    rows += [(doc_id, ids.view(np.int32)) for ids in tables[path].get(doc_id)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])
        for t in tables.values():
            t.close()

    n = max(1, len(bounds))
    ordered = keys.select("doc_id").distinct().repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(read, "doc_id long, ids array<int>")
