"""A training corpus from documents: language ID, near-duplicates, benchmark decontamination, mixing, token shards.

STAGES are functions of (spark, docs, sf_dir); each works on all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearfield.llm.common import cut, drop, noted, remove
from nearfield.llm.decontaminate import without_contaminated
from nearfield.llm.language import without_rejected
from nearfield.llm.minhash import without_near_duplicates
from nearfield.llm.mixing import mixed_documents
from nearfield.llm.sstable import read_digests, write_tokens
from nearfield.session import ship


def _stage(f):
    """f, after the library's modules have gone to the executors."""

    @wraps(f)
    def of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return of


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose language is rejected: no letters, or unlike all languages that the labelled documents teach."""
    return without_rejected(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates at similarity 0.8, that of the smallest doc_id; of rows with equal doc_id and text one. Rows of one doc_id are judged each by its own text; null doc_ids stay."""
    return without_near_duplicates(docs, percent=80)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents in which ten words of a benchmark item stand in a row."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by weight of sources; a document is there once for each pass that takes words of it, with these words."""
    return mixed_documents(docs)


@_stage
def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sorted string tables of the token ids, and what they hold: doc_id, start, n_tokens and checksum of each document."""
    return read_digests(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("token shards", token_shards),
]

#: The stages hash, classify and tokenize; SQL can't express them. Tests hold each stage, or its operator, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last. A stage's scratch tables go as soon as what it gives is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with noted() as made:
            before, docs = docs, cut(stage(spark, docs, sf_dir), "stage")
            remove(spark, *[path for path in made if path != docs.scratch_path])
        if hasattr(before, "scratch_path"):
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
