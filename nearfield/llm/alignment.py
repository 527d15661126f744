"""Alignment of two tokenizers' tokens on the same bytes, by elementary intervals.

The ends of both tokenizers' tokens, united and sorted, cut a text into intervals. Each interval lies in one token of either side, its owners, which a binary search finds; so each interval is
one overlap, a link, and no link has two intervals. Ends that both sides share close groups, in which so many tokens of one side stand for so many of the other. Links are counted by
documents over the whole corpus: shards of texts send the pairs of ids that they hold with counts, and get back the corpus's counts of these pairs alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, drop, lists, pieces, run_bounds, whole_runs

#: Bytes of a shard's texts, and of those that are aligned at once, about.
SHARD, PIECE = 8 << 20, 1 << 20
#: Fixed value: how byte-level vocabularies split a text before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with so long a run of white space are left to the slower of the two encoders, as the faster one backtracks over it.
_WHITE = re.compile(r"\s{1000}")


# ---------------------------------------------------------------- tokenizers


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is visible in Latin-1, the next one from U+0100 on where it is not."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(unseen)}


class ByteLevel:
    """A byte-level BPE vocabulary of the tokenizers library; the strings of special tokens are plain text.

    A plain vocabulary (ids in the order of its merges, the usual split, no normalizer) is given to tiktoken, which encodes alike and some times faster; others to the library itself.
    """

    def __init__(self, path: str) -> None:
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_level_alphabet()
        vocabulary = dict(spec["model"].get("vocab", {})) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.fast = self._fast(spec, alphabet)

    @staticmethod
    def _fast(spec: dict, alphabet: dict[str, int]):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {piece: i for piece, i in model.get("vocab", {}).items() if piece not in special}
        order = [ranks.get(m, -1) for m in merged]
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")) and not spec.get("normalizer")
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or not usual or order != sorted(set(order)) or len(ranks) != len(order) + 256 or any(c not in alphabet for piece in ranks for c in piece):
            return None
        import tiktoken

        return tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(alphabet[c] for c in piece): i for piece, i in ranks.items()}, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _WHITE.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
            self.library.no_truncation()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """A vocabulary of the sentencepiece library; texts are given without the space that it adds."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = range(self.model.get_piece_size())
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in n]

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


class Spelling:
    """Bytes of a vocabulary's tokens in one array."""

    def __init__(self, each: list[bytes]) -> None:
        self.length = np.array([len(x) for x in each], np.int64)
        self.start, self.flat = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(each), np.uint8)

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the tokens' bytes, joined, are raw."""
        at = 0
        for k in range(0, len(ids), 1 << 16):
            length = self.length[ids[k : k + (1 << 16)]]
            end = np.cumsum(length)
            index = np.repeat(self.start[ids[k : k + (1 << 16)]] - end + length, length) + np.arange(end[-1])
            part = self.flat[index]
            if at + len(part) > len(raw) or part.tobytes() != raw[at : at + len(part)]:
                return False
            at += len(part)
        return at == len(raw)


class Pair:
    """Both vocabularies with what the alignment looks up of each: the tokens' bytes, and ids as text before each mark."""

    def __init__(self, a: str, b: str) -> None:
        self.sides = [ByteLevel(a), Pieces(b)]
        self.spelling = [Spelling(t.bytes) for t in self.sides]
        self.length = [s.length for s in self.spelling]
        self.text = [{mark: np.array([f"{i}{mark}" for i in range(len(t.bytes))], object) for mark in marks} for t, marks in zip(self.sides, (",|", ",;"), strict=True)]
        self.width, self.codes = len(self.length[1]), len(self.length[0]) * len(self.length[1])

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Both sides' ids of a text, none where the bytes of either differ from the text's after a space, or the text is null or empty."""
        if text:
            raw, ids = (" " + text).encode(), (self.sides[0](" " + text), self.sides[1](text))
            if all(s.spells(i, raw) for s, i in zip(self.spelling, ids, strict=True)):
                return ids
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


@lru_cache(maxsize=1)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


# ---------------------------------------------------------------- intervals


class Intervals:
    """Tokens of consecutive texts, which begin and end at shared ends, cut into intervals and groups."""

    def __init__(self, a_ids: np.ndarray, b_ids: np.ndarray, a_length: np.ndarray, b_length: np.ndarray) -> None:
        self.a_end, self.b_end = np.cumsum(a_length[a_ids]), np.cumsum(b_length[b_ids])
        self.end = np.union1d(self.a_end, self.b_end)
        #: the tokens in which each interval lies
        self.a, self.b = np.searchsorted(self.a_end, self.end), np.searchsorted(self.b_end, self.end)
        closes = (self.a_end[self.a] == self.end) & (self.b_end[self.b] == self.end)
        #: ends of groups, and the group of each token
        self.shared = self.end[closes]
        self.a_group, self.b_group = np.searchsorted(self.shared, self.a_end), np.searchsorted(self.shared, self.b_end)


def _group_text(iv: Intervals, a_ids: np.ndarray, b_ids: np.ndarray, text) -> np.ndarray:
    """`a1,a2|b1;` of each token in the order of groups, A before B."""
    out = np.empty(len(a_ids) + len(b_ids), object)
    for at, ids, group, mine in (
        (np.arange(len(a_ids)) + np.searchsorted(iv.b_group, iv.a_group, "left"), a_ids, iv.a_group, text[0]),
        (np.arange(len(b_ids)) + np.searchsorted(iv.a_group, iv.b_group, "right"), b_ids, iv.b_group, text[1]),
    ):
        last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
        inside, closing = mine.values()
        out[at[~last]], out[at[last]] = inside[ids[~last]], closing[ids[last]]
    return out


def _encoded(vocabularies: Pair, texts: list[str | None]):
    """Ids of both sides of all texts, one after the other, and where each text's begin."""
    ids = [vocabularies.encode(t) for t in texts]
    first = [np.concatenate([[0], np.cumsum([len(x[side]) for x in ids])]).astype(np.int64) for side in (0, 1)]
    return [np.concatenate([x[side] for x in ids]) for side in (0, 1)], first


def _aligned(a: str, b: str):
    """Per row its counts, the digest of its groups, and its distinct linked pairs (a * width + b) with how often each is linked; shard: rows of one task near each other."""

    def of(batches):
        p, task, chunk, used = pair(a, b), TaskContext.get().partitionId(), 0, 0
        for batch in pieces(batches, "text", PIECE):
            texts = batch.column("text").to_pylist()
            (a_ids, b_ids), (a_first, b_first) = _encoded(p, texts)
            iv = Intervals(a_ids, b_ids, *p.length)
            strings = _group_text(iv, a_ids, b_ids, p.text)
            digest = []
            for k in range(len(texts)):
                s = "".join(strings[a_first[k] + b_first[k] : a_first[k + 1] + b_first[k + 1]].tolist())
                digest.append(hashlib.sha256(s[:-1].encode()).hexdigest() if s else "")
            doc = np.searchsorted(a_first, iv.a, "right") - 1
            ends = np.searchsorted(a_first, np.searchsorted(iv.a_end, iv.shared), "right") - 1
            code, times = np.unique(doc * p.codes + a_ids[iv.a] * p.width + b_ids[iv.b], return_counts=True)
            first = np.searchsorted(code, np.arange(len(texts) + 1) * p.codes)
            if used > SHARD:
                chunk, used = chunk + 1, 0
            used += batch.column("text").nbytes
            counts = [np.diff(a_first), np.diff(b_first), np.bincount(ends, minlength=len(texts)), np.bincount(doc, minlength=len(texts))]
            shard = np.full(len(texts), (task << 32) + chunk, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest), lists(code % p.codes, first, pa.int64()), lists(times, first, pa.int32())],
                ["shard", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return of


def _flat(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    col = t.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False)


def _held(batches):
    """(shard, pair, docs): in how many documents of a shard a pair is linked."""
    for t in whole_runs(batches, "shard"):
        shard = t.column("shard").to_numpy()
        bounds = run_bounds(shard)
        for p, q in zip(bounds[:-1], bounds[1:], strict=True):
            codes, docs = np.unique(_flat(t.slice(p, q - p), "pairs"), return_counts=True)
            for k in range(0, len(codes), 1 << 16):
                part = codes[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard[p])), pa.array(part), pa.array(docs[k : k + (1 << 16)])], ["shard", "pair", "docs"])


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A shard's documents with the corpus's counts of their pairs."""
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    first = np.concatenate([[0], np.cumsum(np.asarray(docs.column("pairs").combine_chunks().value_lengths()))]).astype(np.int64) if docs.num_rows else np.zeros(1, np.int64)
    n_best = count_sum = np.zeros(docs.num_rows, np.int64)
    if first[-1]:
        pairs, times = _flat(docs, "pairs"), _flat(docs, "times").astype(np.int64)
        known, at = np.unique(answers.column("pair").to_numpy(), return_index=True)
        at = at[np.searchsorted(known, pairs)]
        count, best = answers.column("docs").to_numpy()[at], np.asarray(answers.column("best"))[at]
        total = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best, times * count)]
        n_best, count_sum = (t[first[1:]] - t[first[:-1]] for t in total)
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs (doc_id, text; further columns are ignored).

    a: a byte-level BPE file, which encodes a space and the text; b: a sentencepiece model, which encodes the text and adds the space itself. Texts that are null or empty, or whose bytes either side does
    not give back, have no tokens: zeros, and an empty groups_sha256. Rows are documents of their own, whatever their doc_id: repeated rows count each. n_best: links whose pair
    of ids is linked in as many documents as any pair of its A id; count_sum: the number of documents, summed over links. Runs jobs.
    """
    aligned = docs.select("doc_id", "text").mapInArrow(_aligned(a, b), "shard long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    aligned = cut(aligned, "aligned", codec="zstd")
    held = cut(aligned.select("shard", "pairs").mapInArrow(_held, "shard long, pair long, docs long"), "held-pairs")
    width = pair(a, b).width
    counts = held.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"pair div {width}"))
    counts = cut(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    ranked = counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    answers = cut(held.select("shard", "pair").join(ranked, "pair"), "answers")
    drop(held, counts)
    done = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = cut(aligned.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_scored, done), "alignment")
    drop(aligned, answers)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# ---------------------------------------------------------------- groups and links as rows


def alignment_groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per group of docs (doc_id, text): doc_id, nth (from 0), start and end (bytes of the space and the text), a_ids, b_ids, and links: a and b (places among the group's ids), start, end.

    Rows without tokens, as in alignment(), have no groups.
    """

    def of(batches):
        p = pair(a, b)
        for batch in pieces(batches, "text", PIECE):
            (a_ids, b_ids), (a_first, b_first) = _encoded(p, batch.column("text").to_pylist())
            iv, n = Intervals(a_ids, b_ids, *p.length), None
            n = len(iv.shared)
            if not n:
                continue
            start = np.concatenate([[0], iv.shared[:-1]])
            a_at, b_at = (np.searchsorted(g, np.arange(n + 1)) for g in (iv.a_group, iv.b_group))
            doc = np.searchsorted(a_first, a_at[:-1], "right") - 1
            origin = np.concatenate([[0], np.cumsum(p.length[0][a_ids])])[a_first[doc]]
            nth = np.arange(n) - np.searchsorted(doc, doc)
            group = iv.a_group[iv.a]
            begin = np.concatenate([[0], iv.end[:-1]]) - origin[group]
            fields = [iv.a - a_at[group], iv.b - b_at[group], begin, iv.end - origin[group]]
            links = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(fields, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["a", "b", "start", "end"])
            links = pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(n + 1)), pa.int32()), links)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(nth, pa.int64()), pa.array(start - origin), pa.array(iv.shared - origin), lists(a_ids, a_at, pa.int32()), lists(b_ids, b_at, pa.int32()), links],
                ["doc_id", "nth", "start", "end", "a_ids", "b_ids", "links"],
            )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, nth long, start long, end long, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int,start:long,end:long>>")


def group_products(groups: DataFrame) -> DataFrame:
    """Each group's every A id with its every B id: doc_id, nth, a_id, b_id, and linked, whether the two overlap. A group with one token on a side has links alone."""
    one = groups.select("doc_id", "nth", "b_ids", F.transform("links", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("links"), F.posexplode("a_ids").alias("i", "a_id"))
    both = one.select("doc_id", "nth", "i", "a_id", "links", F.posexplode("b_ids").alias("j", "b_id"))
    return both.select("doc_id", "nth", "a_id", "b_id", F.array_contains("links", F.struct(F.col("i").alias("a"), F.col("j").alias("b"))).alias("linked"))
