"""Chat formatting with cumulative-snapshot collapse, with DataFrame functions alone.

A logged conversation that is the beginning of a longer one is a snapshot. Every turn gets the rolling hash of the turns up to it; a conversation whose whole hash is another's
proper prefix hash goes, and of equal ones the smallest conv_id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import cut

#: Turn numbers of a bucket, within which running hashes are made before they are joined over buckets.
BUCKET_TURNS = 64


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").isNull(), "text")


def _hash(pos: Column, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), pos, F.col("role").isNull(), "role", F.lit("|"), f"text_{seed}")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2) of turns (conv_id, turn, role, text): places from 1 and the hashes of all turns up to each; texts are hashed where they are read.

    The hash of a prefix is the exclusive or of its turns' hashes with their places, two of 64 bits; so it rolls in two levels, inside buckets of turn numbers and over
    a conversation's buckets. Turns of equal number follow their role and a hash of their text; null numbers come first; a null conv_id is a conversation.
    """
    bucket = F.coalesce(F.floor(F.col("turn") / BUCKET_TURNS), F.lit(-(1 << 40))).cast("long")
    t = turns.select("conv_id", "turn", "role", _text_hash().alias("text_a"), F.xxhash64(F.lit("b"), F.col("text").isNull(), "text").alias("text_b"), bucket.alias("bucket"))
    inside = Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text_a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("local", F.row_number().over(inside))
    over = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    size = t.groupBy("conv_id", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(over), zero))

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({"conv_id": "conv_", "bucket": "bucket_"})
        return a.join(b, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("bucket") == F.col("bucket_"))).drop("conv_", "bucket_")

    t = join(t, size.select("conv_id", "bucket", "before"))
    pos = F.col("before") + F.col("local")
    t = t.select("conv_id", "bucket", pos.alias("pos"), _hash(pos, "a").alias("h1"), _hash(pos, "b").alias("h2"))
    sums = t.groupBy("conv_id", "bucket").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    sums = sums.select("conv_id", "bucket", F.coalesce(F.bit_xor("s1").over(over), zero).alias("b1"), F.coalesce(F.bit_xor("s2").over(over), zero).alias("b2"))
    by_pos = Window.partitionBy("conv_id", "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("h1", F.bit_xor("h1").over(by_pos)).withColumn("h2", F.bit_xor("h2").over(by_pos))
    t = join(t, sums)
    return t.select("conv_id", "pos", F.col("h1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): the conversations of prefix_hashes() that begin no longer one, once each; copies: how many logs are equal."""
    whole = hashed.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("last")).select("conv_id", "last.pos", "last.h1", "last.h2")
    distinct = whole.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    is_last = whole.select(F.col("conv_id").alias("conv_"), F.col("pos").alias("n"))
    proper = hashed.select("conv_id", "pos", "h1", "h2").join(is_last, F.col("conv_id").eqNullSafe(F.col("conv_"))).where("pos < n").select("pos", "h1", "h2").distinct()
    return distinct.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, text) of every maximal conversation of turns (conv_id, turn, role, text; further columns are ignored).

    A turn is <|im_start|>role, a new line, its text, <|im_end|> and a new line; a null role is "unknown", a null text is empty. No turns, no rows. A
    conversation is one row and so one task's work; its length is that of one training sample.
    """
    hashed = cut(prefix_hashes(turns), "prefixes")
    kept = maximal(hashed).withColumnRenamed("conv_id", "conv_")
    piece = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    both = turns.select("conv_id", "turn", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("conv_")))
    lines = both.groupBy("conv_id", "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", _text_hash().alias("text_a"), piece.alias("piece")))).alias("pieces"))
    return lines.select("conv_id", "n_turns", "copies", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"))


#: The same result in DuckDB, from whole prefixes in place of hashes.
ORACLE = """
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn, role, text) as pos, role, text from conversations
), p as (
  select conv_id, pos, string_agg(coalesce(role, '') || chr(31) || coalesce(text, ''), chr(30)) over (partition by conv_id order by pos rows between unbounded preceding and current row) as prefix,
    count(*) over (partition by conv_id) as n
  from t
), w as (
  select prefix, n, min(conv_id) as conv_id, count(*) as copies from p where pos = n group by prefix, n
), m as (
  select * from w where prefix not in (select prefix from p where pos < n)
)
select m.conv_id, cast(m.n as bigint) as n_turns, cast(m.copies as bigint) as copies, sum(length(x.piece))::bigint as n_chars, sha256(string_agg(x.piece, '' order by x.pos)) as text_sha256
from m join (select conv_id, pos, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as piece from t) x on x.conv_id = m.conv_id
group by m.conv_id, m.n, m.copies
"""
