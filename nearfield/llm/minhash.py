"""Near-duplicate classes by b-bit MinHash with exact confirmation.

Minima of 128 hash functions over 5-word shingles give bands of whole minima, 25 of 5 at similarity 0.85 and 28 of 4 at 0.80; documents that share a band's value are candidates. Of each
minimum the low 4 bits stay, packed into eight 64-bit words; the similarity of two candidates is estimated from the number of equal fields, corrected for
chance collisions. Candidates that pass join a candidate class; inside a class, block against block, the links are confirmed on the full shingle sets,
and the confirmed links give the components. In a hot band or class all members first meet its hub, the best of HUBS members; those linked to it need not meet each other,
so that block pairs have a stray on one side at least. A pair at the threshold misses all bands with probability MISSED at most and falls below the estimate's margin with about 1e-7.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import binaries, components, cut, drop, mix, ngram_hashes, noted, pieces, remove, run_bounds, signed, whole_runs, words_of

SHINGLE = 5
HASHES, BITS = 128, 4
#: How far below the threshold an estimate may lie, in standard deviations at the threshold; how likely a pair at the threshold may miss all bands.
MARGIN, MISSED = 5.2, 5e-7
#: Members of a band's value that are compared in one block; documents of a class that are compared in one block at least and at most.
BAND_BLOCK, CLASS_BLOCK, CLASS_BLOCK_MOST = 512, 128, 1024
#: Members of a hot band or class that are tried as its hub.
HUBS = 4
#: Shingles that a block of a class holds, about.
BLOCK_SHINGLES = 1 << 18

_RNG = np.random.default_rng(1515)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_FIELD = np.uint64(0x1111111111111111)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: whole sequence where it has fewer words, nothing where it has none."""
    w = words_of(texts, lower=True)
    grams = ngram_hashes(w.hash, shingle)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        n = b - a
        if n >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif n:
            out.append(ngram_hashes(w.hash[a:b], int(n)) + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), HASHES) minima of 32-bit hashes; sets must not be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 1 << 15):
            n += len(sets[to])
            to += 1
        h = np.concatenate(sets[at:to])
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64)
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                out[at:to, k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), first)
        at = to
    return out


def pack(minima_: np.ndarray) -> np.ndarray:
    """Low BITS bits of the minima in 64-bit words."""
    low = (minima_ & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(minima_), -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def banding(percent: int) -> tuple[int, int]:
    """Bands and minima a band, as many a band as leave a pair at the threshold a chance of MISSED at most to share no band."""
    for rows in range(HASHES, 0, -1):
        same = min(max(percent / 100, 1e-9), 1 - 1e-9) ** rows
        bands = math.ceil(math.log(MISSED) / math.log1p(-same))
        if bands * rows <= HASHES:
            return bands, rows
    return HASHES, 1


def least_estimate(percent: int) -> float:
    """What the estimate of a pair at the threshold is not below."""
    s, chance = percent / 100, 1 / 2**BITS
    equal = s + (1 - s) * chance
    return s - MARGIN * math.sqrt(equal * (1 - equal) / HASHES) / (1 - chance)


def band_values(minima_: np.ndarray, percent: int) -> np.ndarray:
    """A 64-bit value for each band."""
    bands, rows = banding(percent)
    m = minima_[:, : bands * rows].astype(np.uint64).reshape(len(minima_), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), m.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return h


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures: equal fields counted by bits, corrected for fields equal by chance."""
    d = x ^ y
    d = (d | (d >> np.uint64(1))) & np.uint64(0x3333333333333333) | (d >> np.uint64(2)) & np.uint64(0x3333333333333333)
    d = (d | (d >> np.uint64(1)) | (d >> np.uint64(2)) | (d >> np.uint64(3))) & _FIELD
    same = 1 - np.bitwise_count(d).sum(axis=-1, dtype=np.int64) / HASHES
    chance = 1 / 2**BITS
    return (same - chance) / (1 - chance)


def _sign(percent: int):
    def of(batches):
        for b in pieces(batches, "text"):
            sets = shingle_sets(b.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            packed, bands = [None] * len(sets), [None] * len(sets)
            if full:
                m = minima([sets[i] for i in full])
                for i, p, v in zip(full, pack(m), signed(band_values(m, percent)), strict=True):
                    packed[i], bands[i] = p.tobytes(), v
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), binaries(digest), binaries(packed), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "digest", "packed", "bands"])

    return of


def _star(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Labels of n nodes joined by index pairs: the smallest index reachable."""
    label = np.arange(n)
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while len(i):
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (before == label).all():
                break
    return label


def _candidates(least: float):
    def of(batches):
        for t in whole_runs(batches, "run"):
            run, ids = t.column("run").to_numpy(), t.column("rep").to_numpy()
            sig = np.frombuffer(b"".join(t.column("packed").to_pylist()), np.uint64).reshape(len(run), -1)
            bounds, pairs, d = run_bounds(run), [], 1
            left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(run))  # rows of the run from here on
            here = np.arange(len(run))
            while len(here := here[left[here] > d]):
                ok = estimate(sig[here], sig[here + d]) >= least
                pairs.append((here[ok], here[ok] + d))
                d += 1
            label = _star(pairs, len(run))
            low = np.flatnonzero((label != np.arange(len(run))) & (ids != ids[label]))
            if len(low):
                yield pa.RecordBatch.from_arrays([pa.array(ids[low]), pa.array(ids[label[low]])], ["a", "b"])

    return of


def _bits(least: float):
    """Of each row's signature, a bit for each of the key's hubs that it is near to."""

    def of(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("packed").to_pylist()), np.uint64).reshape(b.num_rows, 1, -1)
            hubs = np.frombuffer(b"".join(b.column("signatures").to_pylist()), np.uint64).reshape(b.num_rows, HUBS, -1)
            near = (estimate(sig, hubs) >= least) @ (1 << np.arange(HUBS))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("rep"), b.column("packed"), b.column("hubs"), pa.array(near, pa.int64())], ["key", "rep", "packed", "hubs", "near"])

    return of


def _near_hubs(members: DataFrame, least: float) -> DataFrame:
    """members (key, rep, packed) of hot keys with hub, that of HUBS members which most are near to, and near: whether the row is; hub itself is. A scratch table below."""
    picked = members.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("by"), "rep", "packed")).alias(f"p{i}") for i in range(HUBS)])
    picked = picked.select("key", F.array(*[f"p{i}.rep" for i in range(HUBS)]).alias("hubs"), F.concat(*[f"p{i}.packed" for i in range(HUBS)]).alias("signatures"))
    tried = cut(members.select("key", "rep", "packed").join(picked, "key").mapInArrow(_bits(least), "key long, rep long, packed binary, hubs array<long>, near long"), "hubs")
    bit = [F.getbit("near", F.lit(i)).cast("long") for i in range(HUBS)]
    best = tried.groupBy("key").agg(*[F.sum(b).alias(f"n{i}") for i, b in enumerate(bit)])
    best = best.select("key", F.array_position(F.array(*[f"n{i}" for i in range(HUBS)]), F.greatest(*[f"n{i}" for i in range(HUBS)])).cast("int").alias("best"))
    out = tried.join(best, "key").select("key", "rep", "packed", F.element_at("hubs", F.col("best")).alias("hub"), (F.getbit("near", F.col("best") - 1) == 1).alias("near"))
    out.scratch_path = tried.scratch_path
    return out


def _class_sets(batches):
    for b in pieces(batches, "text"):
        sets = shingle_sets(b.column("text"))
        keep = [i for i, (s, d) in enumerate(zip(sets, b.column("digest").to_pylist(), strict=True)) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d]
        out = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("rep", "component", "blocks", "hub", "packed")), binaries([sets[i].tobytes() for i in keep])], ["rep", "component", "blocks", "hub", "packed", "shingles"])


def linked_to(hub: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets have 100 * intersection >= percent * union with hub; all sorted, distinct and not empty."""
    size, flat = np.array([len(s) for s in sets]), np.concatenate(sets)
    same = hub[np.minimum(np.searchsorted(hub, flat), len(hub) - 1)] == flat
    both = np.add.reduceat(same, np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64)
    return 100 * both >= percent * (size + len(hub) - both)


def _beside_hub(percent: int):
    """Rows of runs that each hold their class's hub, with near: whether the row is linked to it. The hub's copies, not at home in a run, are left out."""

    def of(batches):
        for t in whole_runs(batches, "run"):
            bounds, ids = run_bounds(t.column("run").to_numpy()), t.column("rep").to_numpy()
            hubs, home = t.column("hub").to_numpy(), np.asarray(t.column("home"))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = t.slice(a, b - a)
                sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
                at = np.flatnonzero(ids[a:b] == hubs[a:b])
                near = linked_to(sets[at[0]], sets, percent) if len(at) else np.zeros(b - a, bool)
                out = part.append_column("near", pa.array(near)).filter(pa.array(home[a:b]))
                yield from out.select(["rep", "component", "blocks", "hub", "packed", "shingles", "near"]).combine_chunks().to_batches()

    return of

def _confirmed(percent: int):
    def of(batches):
        for t in whole_runs(batches, "run"):
            run, bounds = t.column("run").to_numpy(), None
            bounds = run_bounds(run)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                part = t.slice(a, b - a)
                links = confirm(part.column("rep").to_numpy(), [np.frombuffer(x, np.uint64) for x in part.column("packed").to_pylist()], [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()], percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return of


def confirm(ids, packed, sets, percent: int) -> list[tuple[int, int]]:
    """Links that join the block's documents into the components of all its pairs with 100 * intersection >= percent * union."""
    sig, size = np.array(packed), np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    label, links = np.arange(len(ids)), []
    mark = np.zeros(int(local.max(initial=0)) + 1, bool)
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        j = j[(label[j] != label[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
        if len(j):
            j = j[estimate(sig[i], sig[j]) >= least_estimate(percent)]
        if not len(j):
            continue
        own = local[first[i] : first[i + 1]]
        mark[own] = True
        flat = np.concatenate([local[first[x] : first[x + 1]] for x in j])
        both = np.add.reduceat(mark[flat], np.concatenate([[0], np.cumsum(size[j])[:-1]]), dtype=np.int64)
        mark[own] = False
        for x in j[100 * both >= percent * (size[j] + size[i] - both)]:
            if label[x] != label[i]:
                if ids[i] != ids[x]:
                    links.append((int(ids[i]), int(ids[x])))
                label[label == label[x]] = label[i]
    return links


def _upto(n, body):
    """body of 0 to n - 1, as an array; empty for 0."""
    return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda i: i < n), body)


def _block_pairs(df: DataFrame, key: str) -> DataFrame:
    """Each row once for every pair of blocks in which it meets others; run: the pair. Blocks of strays meet each other and those of the rest (near), which don't meet each other.

    stray_blocks and near_blocks: how many of either the key has; near: of which kind the row is.
    """
    s, n = F.col("stray_blocks"), F.col("near_blocks")
    own = F.pmod(F.xxhash64("rep"), F.greatest(F.when(F.col("near"), n).otherwise(s), F.lit(1).cast("long")))
    df = df.withColumn("own", own)
    among = _upto(s, lambda i: F.xxhash64(key, F.lit("strays"), F.least("own", i), F.greatest("own", i)))
    with_near = _upto(n, lambda i: F.xxhash64(key, F.lit("near"), "own", i))
    with_strays = _upto(s, lambda i: F.xxhash64(key, F.lit("near"), i, "own"))
    return df.withColumn("run", F.explode(F.when(F.col("near"), with_strays).otherwise(F.concat(among, with_near)))).drop("own")


def _whole_runs_of(df: DataFrame) -> DataFrame:
    return df.repartition("run").sortWithinPartitions("run")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of docs (doc_id, text; further columns are ignored); text_hash: F.xxhash64("text"), which tells rows of one doc_id apart.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id reachable. Null, empty
    and blank texts have no shingles and stay alone; a null doc_id takes no part: component_id is null and the row is kept. Rows that share text share a class.
    """
    docs = docs.select("doc_id", "text")
    signed_ = cut(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sign(percent), "doc_id long, text_hash long, n_shingles long, digest binary, packed binary, bands array<long>"), "signatures")
    full = signed_.where("digest is not null and doc_id is not null")
    # one representative for all documents with the same set
    reps = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("packed").alias("packed"), F.min("bands").alias("bands"))
    reps = cut(reps, "representatives")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    # a table of its own, so that both sides of the join are plain shuffles, of which Spark splits the hot partitions
    shared = cut(banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "shared-bands")
    members = cut(banded.join(shared, "band").join(reps.select("rep", "packed"), "rep").select(F.col("band").alias("key"), "rep", "packed", "m"), "members")
    hot = _near_hubs(members.where(F.col("m") > BAND_BLOCK), least_estimate(percent))
    counts = hot.groupBy("key").agg(F.sum(F.when(F.col("near"), 0).otherwise(1)).alias("strays"), F.count("*").alias("m"))
    counts = counts.select("key", F.ceil(F.col("strays") / BAND_BLOCK).alias("stray_blocks"), F.ceil((F.col("m") - F.col("strays")) / BAND_BLOCK).alias("near_blocks"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    cold = members.where(F.col("m") <= BAND_BLOCK).select("key", "rep", "packed", F.lit(False).alias("near"), one.alias("stray_blocks"), none.alias("near_blocks"))
    met = cold.unionByName(hot.drop("hub").join(counts, "key"))
    met = _whole_runs_of(_block_pairs(met, "key").select("run", "rep", "packed"))
    alike = met.mapInArrow(_candidates(least_estimate(percent)), "a long, b long")
    classes = components(alike.unionByName(hot.where("near").select(F.col("rep").alias("a"), F.col("hub").alias("b")))).withColumnRenamed("node", "rep")
    classes = classes.join(reps.select("rep", "digest", "packed", "n"), "rep")
    classes = cut(classes, "classes")
    drop(members, hot, shared)
    size = classes.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    per = F.least(F.greatest(3 * F.sqrt("m"), F.lit(CLASS_BLOCK)), F.lit(CLASS_BLOCK_MOST))
    size = size.select("component", F.ceil(F.greatest(F.col("m") / per, F.col("shingles") / BLOCK_SHINGLES)).alias("blocks"))
    classed = classes.join(size, "component").select("rep", "component", "digest", "packed", "blocks")
    tried = _near_hubs(classed.where("blocks > 1").select(F.col("component").alias("key"), "rep", "packed"), percent / 100)
    hubs = tried.groupBy("key").agg(F.min("hub").alias("hub")).withColumnRenamed("key", "component")
    wanted = classed.join(hubs, "component", "left")
    sets = docs.join(wanted, docs.doc_id == wanted.rep).drop("doc_id").mapInArrow(_class_sets, "rep long, component long, blocks long, hub long, packed binary, shingles binary")
    sets = cut(sets, "class-sets")
    # the hub goes to every block of its class
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    beside = sets.where("blocks > 1").withColumn("own", own).withColumn("at", F.explode(F.when(F.col("rep") == F.col("hub"), _upto(F.col("blocks"), lambda i: i)).otherwise(F.array("own"))))
    beside = _whole_runs_of(beside.withColumn("run", F.xxhash64("component", "at")).withColumn("home", F.col("own") == F.col("at")).drop("own", "at"))
    beside = cut(beside.mapInArrow(_beside_hub(percent), "rep long, component long, blocks long, hub long, packed binary, shingles binary, near boolean"), "beside-hubs")
    counts = beside.groupBy("component").agg(F.sum(F.when(F.col("near"), 0).otherwise(1)).alias("strays"), F.count("*").alias("m"), F.min("blocks").alias("of"))
    share = F.col("of") / F.col("m")
    counts = counts.select("component", F.ceil(F.col("strays") * share).alias("stray_blocks"), F.ceil((F.col("m") - F.col("strays")) * share).alias("near_blocks"))
    cold = sets.where("blocks = 1").select("rep", "component", "packed", "shingles", F.lit(False).alias("near"), one.alias("stray_blocks"), none.alias("near_blocks"))
    met = cold.unionByName(beside.drop("blocks", "hub").join(counts, "component"))
    blocks = _whole_runs_of(_block_pairs(met, "component").select("run", "rep", "packed", "shingles"))
    to_hub = beside.where("near and rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    linked = components(blocks.mapInArrow(_confirmed(percent), "a long, b long").unionByName(to_hub)).withColumnRenamed("node", "rep")
    linked = cut(reps.select("digest", "rep").join(linked, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "components")
    drop(classes, reps, tried, sets, beside)
    out = signed_.select("doc_id", "text_hash", "n_shingles", "digest").join(linked, "digest", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        "text_hash",
    )


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id; of rows with equal doc_id and text one. Columns as they are, whatever their names.

    A row is kept or left out by its doc_id and text, so that rows of one doc_id are judged each by its own text. Rows with a null doc_id stay. What is left in the scratch folder is the table of kept rows.
    """
    with noted() as made:
        kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
        kept = cut(kept, "kept")
        remove(docs.sparkSession, *[path for path in made if path != kept.scratch_path])
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("source"))
    return rows.withColumn("nth", nth).where("nth = 1 or doc_id is null").select("whole_row.*")
