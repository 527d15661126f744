"""Language-model scores by a probabilistic suffix tree over words.

The root's distribution is that of all training words, whole. Contexts are one to depth words long; a context that occurs a least number of times (LEAST_COUNT in op2, whatever
the corpus) is a candidate, and stays if its next-symbol distribution diverges from its shorter suffix's by more than sampling explains. Below the root the alphabet is the words that
occur as often, the end of a text, and all rarer words as one symbol, whose members share its probability as at the root. A context's distribution is smoothed
towards its suffix's. A text's score is the sum over its tokens of the log10 probability in the longest retained suffix of what precedes.

The tree grows with the corpus, and none of it is gathered on the driver or broadcast. Texts are dealt into shards. For each depth a shard sends the different n-grams of its texts,
with their counts in its training texts, to buckets by context; a bucket adds the counts up, judges its contexts and answers each shard with the totals, in the order in
which the shard asked, so that an answer is counts alone. The next depth goes on from these. A context with more occurrences than a bucket should hold is dealt to several
buckets by next symbol, and is judged from their sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, drop, give_back, mix, noted, remove, signed, words_of

#: Least count of a context and of a symbol of the contexts' alphabet, so that the tree grows with the corpus.
LEAST_COUNT = 5
#: Words of the longest contexts.
DEPTH = 4
#: A context stays if it diverges by so many nats a token, beyond what as many draws from the suffix's distribution would.
DIVERGENCE = 0.01
#: Weight, in tokens, of the suffix's distribution in a context's.
SMOOTHING = 50.0
END, RARE = np.uint64(0x5EEDE5D0F7E87001), np.uint64(0x5EEDE5D0F7E87002)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Text of a shard, in characters, and the least number of shards; there are as many buckets.
SHARD_CHARS, LEAST_SHARDS = 12 << 20, 12
#: Occurrences of a context that go to one bucket.
BUCKET_TOKENS = 1 << 22
#: Bytes of an n-gram's key that are sent: all for words; below the root the upper bytes tell the context, which is sent whole, and the lower ones the symbol.
WORD_BYTES, GRAM_BYTES = 8, 5
_LOW = np.uint64((1 << (8 * GRAM_BYTES)) - 1)

#: A shard, in rows of at most PIECE_BYTES a column: m tokens, the different ones, numbers of those in order, and of each text whether it is learned from, its number of
#: tokens and its doc_id.
_SHARD = "shard int, part int, m long, words binary, codes binary, learn binary, sizes binary, doc_id array<long>"
#: Small enough for a row to be no large object to the JVM.
PIECE_BYTES = 1 << 17
_ASKED = "bucket int, shard int, m int, keys binary, n binary, ctx binary, runs binary, parents binary, hot binary"
#: An answer: m counts, and for each run of n-grams with the same context whether it stays; hot: contexts of which several buckets hold parts. Or, with shard -1, figures of
#: such a context (ctx) or, at the root, of words that occur equally often (ctx times).
_TOLD = "shard int, bucket int, m int, counts binary, keep binary, hot array<long>, ctx long, entropy double, symbols long, total long"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and where the texts begin (and the length)."""
    w = words_of(texts, lower=True)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    out = np.empty(first[-1], np.uint64)
    ends = first[1:] - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[ends], out[word] = END, w.hash
    return out, first


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(np.int64).tobytes(), "zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * 8, "zstd", asbytes=True), np.int64)


def _narrow(keys: np.ndarray, width: int) -> bytes:
    return keys.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(x: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of rows with equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _argsort(key: np.ndarray) -> np.ndarray:
    """The order of keys: their upper bits and their places are sorted as one number, and what that leaves in disorder by itself, which takes half the time of an argsort."""
    low = np.uint64((1 << max(1, len(key).bit_length())) - 1)
    both = np.sort(key & ~low | np.arange(len(key), dtype=np.uint64))
    order, upper = (both & low).astype(np.int64), both & ~low
    k = key[order]
    wrong = np.unique(upper[1:][k[1:] < k[:-1]])
    if len(wrong):
        edge = np.zeros(len(key) + 1, np.int8)
        edge[np.searchsorted(upper, wrong)] += 1
        edge[np.searchsorted(upper, wrong, side="right")] -= 1
        mixed = np.cumsum(edge[:-1], dtype=np.int8) > 0
        order[mixed] = order[mixed][np.argsort(k[mixed], kind="stable")]
    return order


def _released(f, *tables: pa.Table | None) -> pa.Table:
    """f of tables; freed memory goes back to the system once f's arrays have gone."""
    out = f(*tables)
    give_back()
    return out


def _encode(texts: pa.Table) -> pa.Table:
    texts = texts.sort_by("row").combine_chunks()
    h, first = tokens(texts.column("text"))
    order = _argsort(h)
    new = _runs(h[order])
    often = np.diff(np.append(new, len(h)))
    by_count = np.argsort(-often, kind="stable")
    number = np.empty(len(new), np.int32)
    number[by_count] = np.arange(len(new), dtype=np.int32)
    codes = np.empty(len(h), np.int32)
    codes[order] = np.repeat(number, often)
    learn = texts.column("learn").to_numpy(zero_copy_only=False).tobytes()
    columns = [h[order[new]][by_count].tobytes(), pa.compress(codes.tobytes(), "zstd", asbytes=True), learn, _packed(np.diff(first))]
    ids = pa.concat_arrays(texts.column("doc_id").cast(pa.int64()).chunks)
    n = max(1, *(-(-len(c) // PIECE_BYTES) for c in columns), -(-len(ids) * 8 // PIECE_BYTES))
    edges = np.minimum(np.arange(n + 1) * (PIECE_BYTES // 8), len(ids))
    parts = [pa.array([c[i * PIECE_BYTES : (i + 1) * PIECE_BYTES] for i in range(n)], pa.binary()) for c in columns]
    head = [pa.array([texts.column("shard")[0].as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([len(h)] * n, pa.int64())]
    return pa.table([*head, *parts, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids)], names=[f.split()[0] for f in _SHARD.split(", ")])


def _encoded(texts: pa.Table) -> pa.Table:
    """A shard's texts, split into words once: its different tokens, the most frequent first, each place's number among them, and what is known of each text, in pieces."""
    return _released(_encode, texts)


class Walk:
    """Tokens of a shard's texts, in contexts that grow by a word a step.

    At each depth asked() gives the different n-grams that want counts, in a fixed order, and told() takes the counts in that order. at: the places whose context may stay;
    key, ctx, total and parent are theirs alone.
    """

    def __init__(self, words: np.ndarray, codes: np.ndarray, sizes: np.ndarray, buckets: int, most: int) -> None:
        self.words, self.codes, self.buckets, self.most = words, codes, buckets, most
        first = np.cumsum(sizes) - sizes
        self.place = np.arange(len(codes), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
        self.at, self.depth = np.arange(len(codes)), 0
        self._sort()

    def _sort(self) -> None:
        """The different n-grams in order of buckets and keys; those of a context stand together, but for contexts whose keys begin alike."""
        if self.depth:
            perm = _argsort(self.key)
            key = self.key[perm]
            new = _runs(key) if len(key) else np.zeros(0, np.int64)
            one = perm[new]
            self.u, self.u_ctx = key[new], self.ctx[one]
            parts = (-(-self.total[one] // self.most)).astype(np.uint64)
            with np.errstate(over="ignore"):
                home = mix(self.u_ctx + ((self.u & _LOW) % np.maximum(parts, np.uint64(1))) * _BASE)
            self.u_hot = parts > 1
        else:
            self.u, self.u_ctx, self.u_hot = self.words, np.zeros(len(self.words), np.uint64), np.zeros(len(self.words), bool)
            home = self.u
        self.u_bucket = (home % np.uint64(self.buckets)).astype(np.int32)
        self.order = np.argsort(self.u_bucket.astype(np.uint16) if self.buckets < 1 << 16 else self.u_bucket, kind="stable")
        rank = np.empty(len(self.order), np.int32)
        rank[self.order] = np.arange(len(self.order), dtype=np.int32)
        if self.depth:
            self.back = np.empty(len(perm), np.int32)  # of each open place, the n-gram as asked for
            self.back[perm] = np.repeat(rank, np.diff(np.append(new, len(key))))
        else:
            self.rank, self.back = rank, rank[self.codes]

    def asked(self, learn: np.ndarray) -> Iterator[dict]:
        """A row for each bucket: n-grams, their counts where learn holds, and the runs of equal contexts with the sums of the logarithms of their suffixes' probabilities."""
        o = self.order
        learn = learn[self.at]
        n = np.bincount(self.back[learn], minlength=len(o))
        logs = np.bincount(self.back[learn], weights=np.log(self.parent[learn]), minlength=len(o)) if self.depth else np.zeros(len(o))
        bucket, ctx = self.u_bucket[o], self.u_ctx[o]
        run = _runs(bucket, ctx) if len(o) else np.zeros(0, np.int64)
        logs = np.add.reduceat(logs, run) if len(o) else logs
        long = np.diff(np.append(run, len(o)))
        edges = np.append(_runs(bucket), len(o)) if len(o) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            r = slice(*np.searchsorted(run, (a, b)))
            yield {
                "bucket": int(bucket[a]),
                "m": int(b - a),
                "keys": _narrow(self.u[o[a:b]], GRAM_BYTES if self.depth else WORD_BYTES),
                "n": _packed(n[a:b]),
                "ctx": ctx[run[r]].tobytes() if self.depth else b"",
                "runs": _packed(long[r]) if self.depth else b"",
                "parents": logs[r].astype(np.float32).tobytes() if self.depth else b"",
                "hot": self.u_hot[o[run[r]]].tobytes() if self.depth else b"",
            }

    def told(self, answers: list[dict], root: dict) -> None:
        """Take the counts of what asked() gave, and step on to contexts that are a word longer."""
        o = self.order
        counts = np.concatenate([_unpacked(a["counts"], a["m"]) for a in answers]) if answers else np.zeros(0, np.int64)
        n, at = counts[self.back], self.at
        if not self.depth:
            self.times = counts[self.rank]  # of each different token, as are the symbols
            end, frequent = self.words == END, (self.times >= root["least"]) & (self.words != END)
            self.symbol = np.where(frequent | end, self.words, RARE)
            self.frequent, self.root = frequent[self.codes], np.where(self.symbol == RARE, root["rare"], (self.times + 0.5) / root["bottom"])[self.codes]
            self.gain, self.p = np.zeros(len(at)), self.root.copy()
        else:
            p = (n + SMOOTHING * self.parent) / (self.total + SMOOTHING)
            run = _runs(self.u_bucket[o], self.u_ctx[o]) if len(o) else np.zeros(0, np.int64)
            keep = np.concatenate([np.frombuffer(a["keep"], bool) for a in answers]) if answers else np.zeros(0, bool)
            for a in answers:
                if a["kept"]:
                    keep = keep | ((self.u_bucket[o[run]] == a["bucket"]) & np.isin(self.u_ctx[o[run]], np.array(a["kept"], np.int64).view(np.uint64)))
            use = np.repeat(keep, np.diff(np.append(run, len(o))))[self.back]
            self.gain[at[use]] = np.log10(p[use] / self.root[at[use]])
            self.p[at] = p
        self.depth += 1
        # a gram's context is the gram that ends one word before; an end, after which a text begins, is in none
        go = np.flatnonzero(self.frequent[at] & (n >= root["least"]))
        go = go[self.place[at[go] + 1] >= self.depth]
        self.ctx = self.key[go] if self.depth > 1 else self.words[self.codes[go]]
        self.at, self.total = at[go] + 1, n[go]
        self.parent = self.p[self.at]
        with np.errstate(over="ignore"):
            self.key = mix(self.ctx) & ~_LOW | mix(self.ctx * _BASE + self.symbol[self.codes[self.at]] + np.uint64(self.depth)) & _LOW


def _joined(shard: pa.Table, column: str) -> bytes:
    """A column of a shard from its pieces."""
    return b"".join(shard.select(["part", column]).sort_by("part").column(column).to_pylist())


def _walked(shard: pa.Table, answers: pa.Table | None, depth: int, buckets: int, most: int, root: dict) -> tuple[Walk, np.ndarray]:
    """The walk of a shard's texts at depth, after the answers of all depths above, and how many tokens each text has."""
    m = shard.column("m")[0].as_py()
    words, codes, sizes, learn = (_joined(shard, c) for c in ("words", "codes", "sizes", "learn"))
    codes = np.frombuffer(pa.decompress(codes, m * 4, "zstd", asbytes=True), np.int32)
    sizes = _unpacked(sizes, len(learn))
    w = Walk(np.frombuffer(words, np.uint64), codes, sizes, buckets, most)
    told = answers.select(["depth", "bucket", "m", "counts", "keep", "kept"]).to_pylist() if answers is not None else []
    told.sort(key=lambda a: (a["depth"], a["bucket"]))
    for d in range(depth):
        w.told([a for a in told if a["depth"] == d], root)
        if d < depth - 1:
            w._sort()
    return w, sizes


def _ask(depth: int, buckets: int, most: int, root: dict):
    def asked(left: pa.Table, right: pa.Table | None) -> pa.Table:
        w, sizes = _walked(left, right, depth, buckets, most, root)
        if depth:
            w._sort()
        learn = np.repeat(np.frombuffer(_joined(left, "learn"), bool), sizes)
        shard = left.column("shard")[0].as_py()
        rows = [{**r, "shard": shard} for r in w.asked(learn)]
        names = [f.split()[0] for f in _ASKED.split(", ")]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 6
        out = pa.table({c: pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)})
        return out

    def words(left: pa.Table) -> pa.Table:
        return _released(asked, left, None)

    def grams(left: pa.Table, right: pa.Table) -> pa.Table:
        return _released(asked, left, right)

    return grams if depth else words


def _tell(depth: int):
    width = GRAM_BYTES if depth else WORD_BYTES

    def told(asked: pa.Table) -> pa.Table:
        """A bucket's answers: totals of the n-grams, in each shard's order, and which contexts stay."""
        rows = sorted(asked.to_pylist(), key=lambda r: r["shard"])
        edges = np.cumsum([0, *(r["m"] for r in rows)])
        key = np.concatenate([_wide(r["keys"], width) for r in rows])
        n = np.concatenate([_unpacked(r["n"], r["m"]) for r in rows])
        bucket, out, figures = rows[0]["bucket"], [], []
        if depth:
            run_ctx, run_log, run_hot = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("ctx", np.uint64), ("parents", np.float32), ("hot", bool)))
            run_len = np.concatenate([_unpacked(r["runs"], len(r["ctx"]) // 8) for r in rows])
            ctx = np.repeat(run_ctx, run_len)
            with np.errstate(over="ignore"):
                key = mix(ctx * _BASE + key)
        perm = np.argsort(key)
        new = _runs(key[perm])
        u, one, total = key[perm[new]], perm[new], np.add.reduceat(n[perm], new)
        back = np.empty(len(key), np.int64)
        back[perm] = np.repeat(total, np.diff(np.append(new, len(key))))
        if depth:
            c, c_one, c_back = np.unique(run_ctx, return_index=True, return_inverse=True)
            own = np.repeat(c_back, run_len)[one]
            some = total > 0
            entropy = np.bincount(own[some], weights=total[some] * np.log(total[some]), minlength=len(c)) - np.bincount(c_back, weights=run_log, minlength=len(c))
            symbols, sums = np.bincount(own[some], minlength=len(c)), np.bincount(own, weights=total, minlength=len(c)).astype(np.int64)
            stays, hot = diverges(entropy, symbols, np.maximum(sums, 1)) & (sums > 0), run_hot[c_one]
            run_keep = (stays & ~hot)[c_back]
            figures = list(zip(signed(c[hot]).tolist(), entropy[hot].tolist(), symbols[hot].tolist(), sums[hot].tolist(), strict=True))
            run_edges = np.searchsorted(np.cumsum(np.append(0, run_len)), edges)
        else:
            end = u == END
            for which, mark in ((end, 1.0), (~end, 0.0)):
                times, words = np.unique(total[which & (total > 0)], return_counts=True)
                figures += [(int(t), mark, int(w), int(t) * int(w)) for t, w in zip(times, words, strict=True)]
        for i, r in enumerate(rows):
            hots, keep = None, b""
            if depth:
                part = slice(run_edges[i], run_edges[i + 1])
                keep, hots = run_keep[part].tobytes(), signed(run_ctx[part][run_hot[part]]).tolist() or None
            out.append((r["shard"], bucket, r["m"], _packed(back[edges[i] : edges[i + 1]]), keep, hots, None, None, None, None))
        out += [(-1, bucket, None, None, None, None, *f) for f in figures]
        names = [f.split()[0] for f in _TOLD.split(", ")]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.int64()), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        table = pa.table({name: pa.array(list(x), k) for name, x, k in zip(names, zip(*out, strict=True), kinds, strict=True)})
        return table

    def of(asked: pa.Table) -> pa.Table:
        return _released(told, asked)

    return of


def diverges(entropy, symbols, total):
    """Whether contexts stay; entropy: the sum of n * log(n / parent) over their symbols, total the sum of n."""
    return entropy / total - np.log(total) - symbols / (2 * total) >= DIVERGENCE


def _told(asked: DataFrame, depth: int) -> DataFrame:
    """The answers of a depth as a table, with the contexts of several buckets that stay in kept."""
    told = cut(asked.groupBy("bucket").applyInArrow(_tell(depth), _TOLD).withColumn("depth", F.lit(depth)), "told")
    hot = told.where("shard < 0") if depth else told.limit(0)
    if not depth or not hot.limit(1).count():
        return told.withColumn("kept", F.lit(None).cast("array<long>"))
    sums = hot.groupBy("ctx").agg(F.sum("entropy").alias("entropy"), F.sum("symbols").alias("symbols"), F.sum("total").alias("total"))
    stays = sums.where(F.col("entropy") / F.col("total") - F.log("total") - F.col("symbols") / (2 * F.col("total")) >= DIVERGENCE).select("ctx")
    kept = told.where("shard >= 0 and hot is not null").select("shard", "bucket", F.explode("hot").alias("ctx")).join(stays, "ctx")
    kept = kept.groupBy("shard", "bucket").agg(F.collect_list("ctx").alias("kept"))
    out = cut(told.where("shard >= 0").join(kept, ["shard", "bucket"], "left"), "told")
    drop(told)
    return out


def score(docs: DataFrame, is_training, depth: int = DEPTH, least: float = LEAST_COUNT, most: int = BUCKET_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, *) of every row of docs (doc_id, text), learning from those where is_training, a condition on doc_id, holds.

    Null and empty texts are their end alone. base_score: the sum of log10((c + 0.5) / (N + 0.5 * (V + 1))); score: the same under the tree. Without
    training rows every token's probability is 1. Repeated rows are scored and counted each for itself. least: how often a context or symbol must occur,
    twice at least. most: how many occurrences of a context go to one bucket; it changes no result.
    """
    with noted() as made:
        out = _scored(docs, is_training, depth, least, most)
        remove(docs.sparkSession, *[path for path in made if path != out.scratch_path])
    return out


def _scored(docs: DataFrame, is_training, depth: int, least: float, most: int) -> DataFrame:
    docs = docs.select("doc_id", "text", F.coalesce(is_training, F.lit(False)).alias("learn"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, math.ceil(chars / SHARD_CHARS))
    # by row, as ids and texts may repeat; a table, so that texts are read and split into words once
    dealt = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    dealt = cut(dealt.groupBy("shard").applyInArrow(_encoded, _SHARD), "dealt")
    texts, root = dealt.groupBy("shard"), {"least": 0.0, "rare": 1.0, "bottom": 1.0}
    told = [_told(texts.applyInArrow(_ask(0, shards, most, root), _ASKED), 0)]
    words = told[0].where("shard < 0")
    n, v = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("symbols"), F.lit(0))).first()
    least = max(2.0, float(least))
    known = words.where((F.col("entropy") == 1) | (F.col("ctx") >= least)).agg(F.coalesce(F.sum(F.col("symbols") * (F.col("ctx") + 0.5)), F.lit(0.0))).first()[0]
    bottom = n + 0.5 * (v + 1)
    root = {"least": least, "rare": max(1.0 - known / bottom, 1e-12), "bottom": bottom}

    def answers() -> DataFrame:
        out = told[0]
        for t in told[1:]:
            out = out.unionByName(t, allowMissingColumns=True)
        return out.where("shard >= 0").select("shard", "depth", "bucket", "m", "counts", "keep", "kept").groupBy("shard")

    for d in range(1, depth + 1):
        told.append(_told(texts.cogroup(answers()).applyInArrow(_ask(d, shards, most, root), _ASKED), d))

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        w, size = _walked(left, right, depth + 1, shards, most, root)
        at = np.cumsum(size) - size
        base = np.add.reduceat(np.log10((w.times + 0.5) / bottom)[w.codes], at) if len(at) else np.zeros(0)
        gain = np.add.reduceat(w.gain, at) if len(at) else np.zeros(0)
        known_ = np.add.reduceat((w.times > 0).astype(np.int64)[w.codes], at) if len(at) else np.zeros(0, np.int64)
        ids = left.sort_by("part").column("doc_id").combine_chunks().flatten()
        return pa.table({"doc_id": ids, "n_tokens": size, "n_known": known_, "base_score": base, "score": base + gain})

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        return _released(scores, left, right)

    done = texts.cogroup(answers()).applyInArrow(of, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return cut(done.withColumn("train_tokens", F.lit(n).cast("long")), "scores")
