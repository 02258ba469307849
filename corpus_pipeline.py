"""A corpus pipeline over ``documents``, each stage on all that the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import jaccard, mixing, packing, quality, suffixes
from larder.llm.queries import tokenizer_path
from larder.llm.texts import small_batches
from larder.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a passage that may stand once in the corpus: some thirty words or more, so that passages of fifty always hold one.
PASSAGE_BYTES = 200
PASSAGE_CORE = 56


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    small_batches(spark)
    return quality.good_documents(docs, COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 on five-word shingles join, the one of least id."""
    small_batches(spark)
    return jaccard.one_of_each(docs, COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one occurrence left of each passage of 200 bytes that repeats; a document of which nothing is left goes.

    A character that a removed passage only partly covers stays.
    """
    small_batches(spark)
    kept = [c for c in COLUMNS if c not in ("text", "n_chars")]
    left = suffixes.dedup_suffixes(docs, PASSAGE_BYTES, PASSAGE_CORE, with_text=True, columns=kept, keep_first=True)
    left = left.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return left.where("n_removed = 0 or n_removed < n_bytes").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: sources by target weights, a row for each time a document is taken."""
    small_batches(spark)
    return mixing.mixed_documents(docs, mixing.plan_mix(docs), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 4096."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("good_quality", good_quality),
    ("one_of_near_duplicates", one_of_near_duplicates),
    ("without_repeats", without_repeats),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
