"""Distinct texts of a table, each once, with a key that does not depend on how rows are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["k1", "k2"]
BATCH_TEXTS = 512


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a few hundred at a time: a batch is held by the executor and by its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_TEXTS))


def text_key(text: str = "text") -> list[Column]:
    """128 bits of a text; a null text is an empty one."""
    filled = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(filled).alias("k1"), F.xxhash64(F.lit(1), filled).alias("k2")]


def distinct_texts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A row per different text: ``k1, k2, text, owner`` (least doc_id, null if all are null), ``copies``.

    With ``keep``, ``row`` has these columns of the row with the least ``doc_id`` (null last), ties by the columns' values.

    Copies meet in the tasks that read them first, so a text that a third of all rows share is no hot key. The same
    frame, used again in one query, reuses this one exchange.
    """
    filled = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", filled, *([F.struct(F.col("doc_id").isNull(), "doc_id", *keep).alias("row")] if keep else []))
    return rows.groupBy(*text_key()).agg(
        F.first("text").alias("text"), F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("copies"),
        *([F.min("row").alias("row")] if keep else []),
    )
