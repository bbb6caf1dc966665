"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept. All but the last return the columns of ``documents``, and others
that it may have, as they came. Null and empty texts, very long ones, repeated rows, null identifiers and empty
tables are each operator's to define: a row without text is scored like any other by the classifiers, is a group of
its own among near-duplicates, is never contaminated, and is packed as its end id alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import decontamination, near_dedup, packing, quality, toxicity
from keystrata.llm.learning import held_out
from keystrata.llm.scratch import held, new_path, remove

THRESHOLD = 0.3
TOKENIZER = "byte_bpe_50k.json"
#: Chunks that a worker keeps while it packs: executors that have run four stages have little memory left for it.
HELD_CHUNKS = 60_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking puts above its cut."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(quality.score_column(docs, labels, held_out(F.col("doc_id"), 5, 0), docs["text"]) >= THRESHOLD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not taken for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(toxicity.score_column(docs, labels, held_out(F.col("doc_id"), 4, 2), docs["text"]) < THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.representatives(docs, percent=80, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), held=HELD_CHUNKS)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the classifiers; the tests hold the rows of ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``.

    Each stage's table goes once the next is written; what the last stage returns reads only its own tables.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-").lower(), keep=True)
        with held(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)
    return packed
