"""Mixing sources to target weights, on fixed-length blocks of words.

Each source's documents, in a pseudorandom order, are one stream of words that is cut into blocks of a fixed length. A source gets as many slots of the output as
make up its target. Every slot of an output shard draws its source, with replacement and by the sources' shares, so the source counts of a shard are a multinomial draw.
The few draws by which a source's total then exceeds its slots, a random choice of them, go to the sources that fall short, so totals meet the targets. The k-th draw of a
source with n blocks belongs to pass k div n and names, through that pass's own pseudorandom permutation of the source's block indexes, the block that it takes; slots and
blocks meet in a join on the index.
A pass takes a block at most once and a target stops at three passes, so no document is taken more than three times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import SPACE_WORD, cut, let, noted, remove

#: Words of a block, slots of an output shard, slots that a task makes or a bucket numbers, and stripes in which draws meet their sources, at most.
BLOCK_WORDS, SHARD_SLOTS, TASK_SLOTS, STRIPES = 64, 4096, 1 << 18, 1 << 16
WEIGHTS, CAP = (5, 2, 1), 3
#: Rounds of the permutation's cipher, and how often it goes on from outside 0..n-1; fewer than sqrt(n) values lie outside.
ROUNDS, WALKS = 4, 16


def n_words(text: Column) -> Column:
    """Number of words between white space; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _cipher(x: Column, a: Column, b: Column, seed: tuple[Column, ...]) -> Column:
    """A bijection of 0..a*b-1: a Feistel network whose halves are the quotient and the remainder of b."""
    high, low = F.floor(x / b), x % b
    for r in range(ROUNDS // 2):
        high = F.pmod(high + F.pmod(F.xxhash64(*seed, F.lit(2 * r), low), a), a)
        low = F.pmod(low + F.pmod(F.xxhash64(*seed, F.lit(2 * r + 1), high), b), b)
    return high * b + low


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 that seed picks, at x: a cipher of a little larger domain, applied until it comes back below n.

    Up to n = 256, 16 steps are always enough; beyond, a value needs more with a chance of less than n ** -8.
    """
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")
    once = _cipher(x, a, b, seed)
    walk = let(once, lambda y: F.when(y < n, y).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), y, lambda acc, _: F.when(acc < n, acc).otherwise(_cipher(acc, a, b, seed)))))
    return walk.cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK_WORDS) -> DataFrame:
    """(source, source_size, target, s, blocks, slots) for each source of sized (source, size).

    Sources in order of code points, null last, weigh as weights repeat and share all words; a target stops at cap times its source's size and the
    excess goes to the others by weight. Filling sources in order of size for their weight does that in one pass.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = total.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    t = t.withColumn("w", weight).withColumn("limit", cap * F.col("source_size").cast("double"))
    by_room = Window.orderBy(F.col("limit") / F.col("w"), "s")
    t = t.withColumn("all", F.sum("source_size").over(everything))
    t = t.withColumn("before", F.coalesce(F.sum("limit").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left", F.sum("w").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("all") - F.col("before")) / F.col("left"))
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), "s", "level"))).over(everything)["level"])
    t = t.withColumn("target", F.least("limit", F.col("level") * F.col("w")))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), cap * F.col("blocks"))
    t = t.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0).cast("long")))
    t = t.withColumn("slot0", F.coalesce(F.sum("slots").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return t.withColumn("all_slots", F.sum("slots").over(everything)).select("source", "source_size", "target", "s", "blocks", "slots", "slot0", "all_slots")


def numbered(df: DataFrame, rows: int, *by: str, name: str, seed: int) -> DataFrame:
    """df (id, by) with name: numbers from 0 in a pseudorandom order of the ids of each group; rows is df's size.

    A group's rows are numbered in buckets, which start where the smaller buckets' counts end, so that no group is one task's work.
    """
    h = F.xxhash64("id", F.lit(seed), F.lit(name))
    df = df.withColumn("bucket", F.pmod(h, F.lit(max(1, math.ceil(rows / TASK_SLOTS)))))
    before = F.sum("count").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = df.groupBy(*by, "bucket").count().select(*by, "bucket", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(h, "id")) - 1
    return df.withColumn("inside", inside).join(starts, [*by, "bucket"]).withColumn(name, F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def drawn_slots(targets: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """(s, shard, place, pass, block): every slot of the output with its shard, its place there, and the source's block that it takes in which pass.

    The sources of slots are drawn alike and independently; draws beyond a source's slots, the last ones in a pseudorandom order, fill up sources with too few.
    """
    spark, t = targets.sparkSession, targets.where("slots > 0")
    n = t.agg(F.sum("slots")).first()[0] or 0
    stripe = max(1, math.ceil(n / STRIPES))
    sources = t.select("s", "slots", "slot0", F.explode(F.sequence(F.floor(F.col("slot0") / stripe), F.floor((F.col("slot0") + F.col("slots") - 1) / stripe))).alias("stripe"))
    drawn = spark.range(0, n, 1, max(1, math.ceil(n / TASK_SLOTS))).withColumn("draw", F.pmod(F.xxhash64("id", F.lit(seed), F.lit("draw")), F.lit(max(1, n))))
    drawn = drawn.withColumn("stripe", F.floor(F.col("draw") / stripe)).join(sources, "stripe").where("draw >= slot0 and draw < slot0 + slots").select("id", "s", "slots")
    drawn = cut(numbered(drawn, n, "s", "slots", name="k", seed=seed), "draws")
    got = drawn.groupBy("s").agg(F.count("*").alias("drawn"))
    short = t.join(got, "s", "left").select("s", F.coalesce("drawn", F.lit(0)).alias("k0"), (F.col("slots") - F.coalesce("drawn", F.lit(0))).alias("lack")).where("lack > 0")
    short = short.withColumn("j0", F.coalesce(F.sum("lack").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    short = short.select("s", "k0", "j0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)).alias("i")).select("s", (F.col("k0") + F.col("i")).alias("k"), (F.col("j0") + F.col("i")).alias("j"))
    over = drawn.where("k >= slots").select("id", F.lit(0).alias("one"))
    moved = numbered(over, n, "one", name="j", seed=seed).join(short, "j").select("id", "s", "k")
    slot = drawn.where("k < slots").select("id", "s", "k").unionByName(moved).join(t.select("s", "blocks"), "s")
    slot = slot.withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("long"))
    block = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("s"), F.col("pass"))
    return slot.select("s", F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), (F.col("id") % shard_slots).alias("place"), "pass", block.alias("block"))


def packed(sized: DataFrame, targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """sized with source_size, target, s and start: where each document's words begin in its source's stream.

    The order is that of a hash. Running sums go over two levels of about the square root of the number of documents each, so that no source is one task's work.
    """
    buckets = max(1, math.isqrt(sized.count()))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("bucket")), F.lit(buckets)))
    tops = sized.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("before", F.coalesce(F.sum("sum").over(over), F.lit(0).cast("long")))
    t = targets.withColumnRenamed("source", "source_")
    tops = tops.join(t, F.col("source").eqNullSafe(F.col("source_"))).select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), "before", "source_size", "target", "s")
    inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id", "size", "text_hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    both = sized.join(tops, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    return both.withColumn("start", F.col("before") + F.col("inner")).drop("source_", "bucket_", "bucket", "inner", "before")


def with_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """A scratch table of docs with row (an id), size and text_hash; keep: further columns to carry."""
    return cut(docs.select(*dict.fromkeys(["doc_id", "source", *keep]), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row")), "sized")


def mixture(sized: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK_WORDS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The mix of a table made by with_sizes().

    Returns the rows with source_size and target, and the pieces (row, shard, place, pass, first, words): words first..first+words-1 of a row's text,
    as one slot takes them. Rows without words make no piece; a source without words has target 0; no rows make no piece. Null sources are one source.
    """
    targets = cut(source_targets(sized, weights, cap, block), "targets")
    laid = cut(packed(sized.select("row", "doc_id", "source", "size", "text_hash"), targets, block), "laid")
    own = laid.where("size > 0").select("row", "s", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    slots = drawn_slots(targets, seed=seed)
    # the slots grow with the corpus, however small they look
    pieces = own.join(slots.hint("merge"), ["s", "block"])
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("start"), "size")
    return laid, pieces.select("row", "shard", "place", "pass", first.alias("first"), (last - first).alias("words"))


def taken_words(laid: DataFrame, pieces: DataFrame) -> DataFrame:
    """laid with taken: how many words of each row the mix takes, repeats counted."""
    took = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return laid.join(took, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def _passes(pieces: DataFrame) -> DataFrame:
    """(row, passes): what each pass takes of a row, in order of its words."""
    parts = pieces.groupBy("row", "pass").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"))
    return parts.groupBy("row").agg(F.collect_list(F.struct("pass", "taken", "parts")).alias("passes"))  # three at most


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 1) -> DataFrame:
    """The mix as documents: for each pass that takes words of a document, a row with the words it takes, the text itself where that is all of them.

    Columns doc_id, text, lang, source, n_chars. A document that no pass takes is left out; one that several take is there several times. Left in the scratch folder: the documents with their sizes, from
    which the result is read, and the passes.
    """
    with noted() as made:
        sized = with_sizes(docs, "text", "lang")
        parts = cut(_passes(mixture(sized, weights, cap, seed=seed)[1]), "passes")
        remove(docs.sparkSession, *[path for path in made if path not in (sized.scratch_path, parts.scratch_path)])
    whole = sized.join(parts, "row")

    def text_of(p: Column, words: Column) -> Column:
        chosen = F.flatten(F.transform(p["parts"], lambda x: F.slice(words, (x["first"] + 1).cast("int"), x["words"].cast("int"))))
        return F.when(p["taken"] == F.col("size"), F.col("text")).otherwise(F.array_join(chosen, " "))

    texts = let(F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0)), lambda w: F.transform(F.sort_array("passes"), lambda p: text_of(p, w)))
    out = whole.select("doc_id", F.explode(texts).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")
