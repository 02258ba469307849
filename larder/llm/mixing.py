"""Mixing sources to target weights, in blocks of words.

Every source's rows stand in one pseudorandom order; its words, counted through, fall into fixed-length blocks. Output
shards draw multinomial counts of blocks per source. A source's draws are numbered through all shards, and a keyed
permutation of its block indexes, another one for each pass over the source, tells which block a draw is. Blocks then
join the rows that they cover by index.

The only thing the driver sees is a row per source. A source of any size is dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.textbuf import mix as scramble
from larder.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CEILING = 2.0
BLOCK_WORDS = 128
#: Slots that one task writes.
TASK_SLOTS = 1 << 17
SHARD_SLOTS = 1 << 16
#: Words of a source that one task puts in order.
BUCKET_WORDS = 1 << 19
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | F.Column = "text") -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def target_words(sizes: list[int], weights: list[float], share: float, ceiling: float) -> list[float]:
    """Words to take of each source: shares by weight, where a source full to its ceiling passes on what is over."""
    left, targets = share * sum(sizes), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if unit * weights[s] > ceiling * sizes[s]]
        if not full:
            for s in open_:
                targets[s] = unit * weights[s]
            break
        for s in full:
            targets[s] = ceiling * sizes[s]
            left -= targets[s]
        open_ = [s for s in open_ if s not in set(full)]
    return targets


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1: a Feistel network on the next even number of bits, walked until it is inside."""
    half = np.uint64(1) * ((np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    size = size.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            left, right = right, left ^ (scramble(right + k * np.uint64(2 * turn + 1)) & m)
        x = (left << h) | right
        out[todo] = x
        todo = todo[x >= size[todo]]
    return out.astype(np.int64)


@dataclass
class Mix:
    """``sources``: a row per source with its size and target; ``rows``: a row per document row of at least one word,
    with its source's number and the place of its first word there; ``empty``: rows without words; ``draws``: a row per
    drawn block; ``block_words``."""

    sources: DataFrame
    rows: DataFrame
    empty: DataFrame
    draws: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """Drawn blocks with the rows that they cover: words ``from_word`` to ``to_word`` of the row, ``times`` times."""
        size = F.lit(self.block_words)
        # draws come from a range of a few shards, so Spark would take them for small and broadcast them: they grow with the mix
        times = self.draws.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
        cover = self.rows.withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("size") - 1) / size)))
        )
        first = F.greatest(F.col("block") * size - F.col("at"), F.lit(0))
        last = F.least((F.col("block") + 1) * size - F.col("at"), F.col("size"))
        return cover.withColumns({"from_word": first, "to_word": last}).join(times, ["sid", "block"], "left").fillna(0, ["times"])


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING,
             block_words: int = BLOCK_WORDS, seed: int = SEED, bucket_words: int = BUCKET_WORDS,
             shard_slots: int = SHARD_SLOTS) -> Mix:
    """Plan a mix of all rows of ``doc_id, text, source``.

    Sources in code point order, null last, get the weights in turn. Rows that repeat are rows of their own. A null or
    blank text has no words: it is in ``empty``. Where every text is empty, or the table is, nothing is drawn. Order,
    draws and permutations depend on values and the seed only, so a rerun gives the same mix.
    """
    spark = docs.sparkSession
    kinds = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("text_hash"))
    kinds = cut_lineage(kinds.groupBy(*kinds.columns).agg(F.count(F.lit(1)).alias("copies")))
    found = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    found = sorted(((r["source"], r["n"]) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    names, sizes = [x[0] for x in found], [int(x[1]) for x in found]
    targets = target_words(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, ceiling)
    blocks = [-(-n // block_words) for n in sizes]
    wanted = []
    for n, target, b in zip(sizes, targets, blocks, strict=True):
        whole = int(target // n) if n else 0
        wanted.append(whole * b + round((target - whole * n) * b / n) if n else 0)
    spread = [max(1, -(-n // bucket_words)) for n in sizes]
    sources = spark.createDataFrame(
        [(k, *x) for k, x in enumerate(zip(names, sizes, targets, spread, strict=True))],
        "sid int, source string, source_size long, target double, spread long",
    )

    row = kinds.withColumn("mix_source", F.col("source")).drop("source").join(
        F.broadcast(sources), F.col("mix_source").eqNullSafe(F.col("source"))).drop("mix_source")  # a row per source, made on the driver
    row = row.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.col("spread")))
    filled = row.where("size > 0")
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = filled.groupBy("sid", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    buckets = buckets.select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy(
        F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"), "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    filled = filled.join(buckets, ["sid", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    filled = filled.withColumn("at", F.col("base") + F.col("at") + (F.col("copy") - 1) * F.col("size"))
    keep = ["sid", "doc_id", "source", "text_hash", "copy", "size", "source_size", "target"]
    empty = row.where("size = 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*keep)
    draws = _draws(spark, wanted, blocks, seed, shard_slots)
    return Mix(sources.drop("spread"), filled.select(*keep, "at"), empty, draws, block_words)


def _draws(spark, wanted: list[int], blocks: list[int], seed: int, shard_slots: int) -> DataFrame:
    """A row per slot of the mix: shard, a key to order the shard's slots by, source number, pass and block."""
    want, size = np.array(wanted, dtype=np.int64), np.array(blocks, dtype=np.int64)
    total = int(want.sum())
    if not total:
        return spark.createDataFrame([], "shard long, place long, sid int, pass int, block long")
    share = want / total

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                slots = min(shard_slots, total - shard * shard_slots)
                drawn = np.random.default_rng([seed, shard]).multinomial(slots, share)
                sid = np.flatnonzero(drawn)
                yield pd.DataFrame({"shard": shard, "sid": sid, "n": drawn[sid]})

    counts = spark.range(-(-total // shard_slots)).mapInPandas(count, "shard long, sid int, n long")
    drawn = np.zeros(len(want), dtype=np.int64)
    for r in counts.groupBy("sid").agg(F.sum("n").alias("n")).collect():
        drawn[r["sid"]] = r["n"]
    over, under = np.maximum(drawn - want, 0), np.maximum(want - drawn, 0)
    over_base, under_end = np.cumsum(over) - over, np.cumsum(under)
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.repartition(max(1, -(-total // TASK_SLOTS)), "shard")  # draws of one source are written by many tasks

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, sid, n, start in zip(batch["shard"], batch["sid"], batch["n"], batch["start"], strict=True):
                number, source = np.arange(start, start + n), np.full(n, sid)
                # draws beyond what a source is to give go to the sources that chance left short
                late = np.flatnonzero(number >= want[sid])
                if len(late):
                    spare = over_base[sid] + number[late] - want[sid]
                    source[late] = np.searchsorted(under_end, spare, side="right")
                    number[late] = drawn[source[late]] + spare - (under_end - under)[source[late]]
                turn, index = np.divmod(number, size[source])
                key = scramble(scramble(np.full(n, seed, dtype=np.uint64) + source.astype(np.uint64)) + turn.astype(np.uint64))
                place = scramble(key ^ scramble(index.astype(np.uint64) + np.uint64(7))).astype(np.int64)
                yield pd.DataFrame({"shard": shard, "place": place, "sid": source, "pass": turn,
                                    "block": permuted(index, size[source], key)})

    return counts.mapInPandas(expand, "shard long, place long, sid int, pass int, block long")


def taken_words(mix: Mix) -> DataFrame:
    """Each row of the table with the words that the mix takes of it, repeats counted."""
    keep = ["doc_id", "size", "source_size", "target", "source"]
    pieces = mix.pieces().groupBy("sid", "at", *keep).agg(
        F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).cast("long").alias("taken"))
    return pieces.select(*keep, "taken").unionByName(mix.empty.select(*keep, F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, mix: Mix, columns: list[str]) -> DataFrame:
    """The mix as documents: a row for each time a row is taken, with the words that were taken that time.

    A row taken whole keeps its text as it is; of others, runs of neighbouring pieces are cut out of the text and joined
    by a line break. Rows without words are left out. ``n_chars`` follows the text, other columns are kept.
    """
    of_row = ["doc_id", "source", "text_hash"]
    parts = mix.pieces().where("times > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times"))))
    parts = parts.groupBy(*of_row, "copy", "turn", "size").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("cuts"))  # at most the row's own blocks
    # columns under names of their own, so that extra ones may be called anything
    own = [f"c{k}" for k in range(len(columns))]
    parts = parts.select(*[F.col(c).alias(f"part_{c}") for c in of_row], F.col("size").alias("words"), "cuts")
    texts = docs.select(*[F.col(c).alias(o) for c, o in zip(columns, own, strict=True)], F.col("doc_id").alias("row_doc_id"),
                        F.col("source").alias("row_source"), F.xxhash64("text").alias("row_text_hash"), F.col("text").alias("whole_text"))
    texts = texts.dropDuplicates([f"row_{c}" for c in of_row])
    found = texts.join(parts, F.expr(" and ".join(f"row_{c} <=> part_{c}" for c in of_row)))
    # runs of neighbouring pieces as one cut
    cuts = F.expr("""aggregate(cuts, cast(array() as array<struct<from_word: bigint, to_word: bigint>>), (got, x) ->
        if(size(got) > 0 and element_at(got, -1).to_word = x.from_word,
           concat(slice(got, 1, size(got) - 1), array(struct(element_at(got, -1).from_word as from_word, x.to_word as to_word))),
           concat(got, array(struct(x.from_word as from_word, x.to_word as to_word)))))""")
    found = found.withColumn("runs", cuts)
    whole = F.expr("size(runs) = 1 and runs[0].from_word = 0 and runs[0].to_word = words")
    listed = F.when(~whole, F.expr(r"regexp_extract_all(whole_text, '([^\\x20\\x09-\\x0D]+)', 1)"))
    found = found.withColumn("listed", listed).withColumn("mixed_text", F.when(whole, F.col("whole_text")).otherwise(F.expr(
        "array_join(transform(runs, c -> array_join(slice(listed, cast(c.from_word + 1 as int), cast(c.to_word - c.from_word as int)), ' ')), '\n')")))
    kept = {"text": F.col("mixed_text"), "n_chars": F.length("mixed_text").cast("long")}
    return found.select(*[kept.get(c, F.col(o)).alias(c) for c, o in zip(columns, own, strict=True)])
