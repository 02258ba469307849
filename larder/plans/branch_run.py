"""A shop sweep over landed pages of every source: normalise, gate, upsert, retire, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators import branches as br
from larder.operators import catalog as cat
from larder.operators import geocode as gc
from larder.operators import quality as q
from larder.session import cut_lineage


@dataclass
class BranchRun:
    """Shops after the sweep and its report; nothing is written yet."""

    branches: DataFrame
    report: DataFrame


def locate_isimo(raw: DataFrame, answers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for ``isimo_branches``, tally of outcomes) of ``read_wp_shops`` rows and landed map answers."""
    shops = raw.select(
        "store", "pos", F.col("raw.id").alias("shop_id"), F.col("raw.title.rendered").alias("title"),
        F.col("raw.content.rendered").alias("content"), "municipality", "department",
    )
    # parsed once, asked for twice
    targets = cut_lineage(gc.geocode_questions(gc.shop_targets(shops)))
    resolved = cut_lineage(gc.resolve_locations(targets, gc.combine_answers(answers, now)))
    return resolved, gc.outcome_tally(resolved)


def settle_branches(
    staging: DataFrame,
    branches: DataFrame,
    stores: DataFrame,
    fetch_log: DataFrame,
    saturated: DataFrame,
    started_at: Column,
) -> BranchRun:
    """Close a sweep from the rows of ``normalize_branches``. ``stores`` (slug) are the sources that were asked."""
    staged = cut_lineage(staging)
    gate = q.branch_gate(staged, stores)
    open_stores = gate.where("not aborted").select("store")
    found = br.collect_branches(staged).join(open_stores, "store", "left_semi")
    merged = cut_lineage(cat.upsert_branches(branches, found, started_at))
    zero = F.lit(0).cast("bigint")
    facts = (
        gate.select("store", "aborted")
        .join(found.groupBy("store").agg(F.count(F.lit(1)).alias("found")), "store", "left")
        .join(cat.branch_retirement_facts(merged, started_at), "store", "left")
        .join(q.count_dropped(fetch_log), "store", "left")
        .select(
            "store", "aborted", F.coalesce("pages_dropped", zero).alias("pages_dropped"),
            F.coalesce("found", zero).alias("found"), F.coalesce("missing", zero).alias("missing"),
        )
    )
    retire = q.branch_retirement_gate(facts)
    report = q.branch_run_report(staged, gate, fetch_log, saturated).join(
        retire.select(
            "store", F.col("found").alias("written"),
            F.when(F.col("retire_skip").isNull(), F.col("missing")).otherwise(zero).alias("retired"), "retire_skip",
        ),
        "store",
    )
    return BranchRun(cat.retire_branches(merged, retire, started_at), report)
