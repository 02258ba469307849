"""Small messy tables for the operators of the training-data pipeline."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, bucket string, a string, text_hash string, k1 string"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alba", "bor", "cé", "dun,", "ech.", "fyr", "gø", "hal"]) + rng.choice(["", "a", "o", "en"]) for _ in range(n))


def documents(spark: SparkSession, texts: list, ids: list | None = None, parts: int = 3) -> DataFrame:
    """A documents table with extra columns whose names clash with those used inside the operators."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), 7, "x", "y", "z", "w") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def messy_texts(seed: int = 3) -> list:
    """Passages that texts share, near and exact copies, periodic and empty texts, null, signs of several bytes."""
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (9, 14, 30, 120)]
    texts = [None, "", " \t\n", "one", "ab" * 400, "é" * 300, "naïve — “quoted” text…"]
    for k in range(40):
        parts = [words(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), words(rng, rng.randrange(0, 20))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[9], texts[9], texts[12], "ab" * 350, texts[15] + "!", "x" + texts[15], texts[20][:200] + "?" + texts[20][200:]]
    return texts
