"""Queries of the numbered operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import chat, language, oracles
from nearfield.llm.alignment import alignment
from nearfield.llm.decontaminate import contamination
from nearfield.llm.hyperplanes import cosine_duplicates
from nearfield.llm.knn_join import knn_join
from nearfield.llm.licenses import scan
from nearfield.llm.minhash import near_duplicates
from nearfield.llm.mixing import mixture, taken_words, with_sizes
from nearfield.llm.repeats import repeats_digest
from nearfield.llm.sort_means import sort_means
from nearfield.llm.sstable import read_digests, write_tokens
from nearfield.llm.suffix_tree import LEAST_COUNT, score


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at similarity 0.85 on 5-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("text_hash")


def op2_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a probabilistic suffix tree of those whose crc32 of the id as text is not 1 modulo 5."""
    held_out = F.coalesce(language.remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return score(_table(spark, sf_dir, "documents"), ~held_out, depth=4, least=LEAST_COUNT).withColumn("held_out", held_out)


def op3_voronoi_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th embedding with all others."""
    return knn_join(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as sorted string tables and read back."""
    import public_tokenizers

    return read_digests(write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that 35-word repeats cover, removed from all documents."""
    return repeats_digest(_table(spark, sf_dir, "documents"), window=35)


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and checksum of every rendered conversation that begins no longer one."""
    text = chat.rendered(_table(spark, sf_dir, "conversations"))
    return text.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "copies", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence detections in all documents."""
    return scan(_table(spark, sf_dir, "documents")).drop("found")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents by weight of their sources takes of each."""
    mix = taken_words(*mixture(with_sizes(_table(spark, sf_dir, "documents"))))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 of the id as text is not 2 modulo 4."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(language.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 benchmark words in all documents."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, proximity=True)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and piece tokens of all documents, aligned, with how many documents link each pair of ids."""
    import public_tokenizers

    return alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings at cosine 0.9."""
    return cosine_duplicates(_table(spark, sf_dir, "embeddings"), least=0.9)


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of k-means with 8 clusters over all embeddings, in whole numbers."""
    return sort_means(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_suffix_tree_scores": op2_suffix_tree_scores,
    "op3_voronoi_knn_join": op3_voronoi_knn_join,
    "op4_token_sstable": op4_token_sstable,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_chat_snapshots": op6_chat_snapshots,
    "op7_license_scan": op7_license_scan,
    "op8_source_mixing": op8_source_mixing,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_sort_means": op13_sort_means,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op3_voronoi_knn_join": oracles.KNN_JOIN,
    "op5_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op6_chat_snapshots": chat.ORACLE,
    "op10_decontamination": oracles.CONTAMINATION,
    "op12_embedding_near_dedup": oracles.COSINE_DUPLICATES,
    "op13_sort_means": oracles.SORT_MEANS,
}
