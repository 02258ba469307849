"""A price run over landed pages of every store at once: read, normalise, gate, upsert, diff, append, publish, retire."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators import catalog as cat
from larder.operators import prices as pr
from larder.operators import quality as q
from larder.operators.classify import Taxonomy
from larder.operators.normalize import dedupe_first, normalize_vtex
from larder.session import cut_lineage


@dataclass
class PriceRun:
    """Everything a run decides. Nothing is written yet: hand the parts to the sinks."""

    catalog: DataFrame
    snapshots: DataFrame
    jumps: DataFrame
    current: DataFrame
    quarantine: DataFrame
    report: DataFrame


def stage_vtex(
    raw: DataFrame, aisle_map: DataFrame, name_fields: Mapping[str, str] | None, taxonomy: Taxonomy = Taxonomy()
) -> DataFrame:
    """First aisle wins over the whole run, then every record is normalised once."""
    order = aisle_map.select("store", "aisle_id", F.col("aisle_ord").alias("_ord"))
    first = dedupe_first(raw.join(order, ["store", "aisle_id"], "left"), ["store", "productId"], ["_ord", "page_no", "pos"])
    return normalize_vtex(first.drop("_ord"), aisle_map, name_fields, taxonomy)


def settle(
    staging: DataFrame,
    catalog: DataFrame,
    current: DataFrame,
    categories: DataFrame,
    fetch_log: DataFrame,
    region: str,
    started_at: Column,
    dry_run: bool = False,
    partial: bool = False,
) -> PriceRun:
    """Close a run from its staged rows (``store`` + canonical columns + ``status``).

    Staging is cut once: the gate, the upsert and the diff all read it. Decisions are one row per store and are joined
    back as flags, so no gate is collected.
    """
    staged = cut_lineage(staging)
    gate = q.unreadable_gate(staged)
    open_stores = gate.where("not aborted").select("store")
    rows = dedupe_first(staged.where("status = 'ok'"), ["store", "external_id"], ["page_no", "pos"])
    rows = rows.join(open_stores, "store", "left_semi")
    good, quarantine = q.split_valid(rows, q.checks_for("store_product"))

    priced = good.withColumn("store_product_id", cat.product_id()).select(
        "store", "store_product_id", "price_cop", "list_price_cop"
    )
    diff = pr.diff_prices(priced, current, region)
    appended = pr.to_append(diff, started_at)
    merged = cut_lineage(cat.upsert_catalog(catalog, good, categories, started_at))
    published = pr.publish(current, appended)

    zero = F.lit(0).cast("bigint")
    found = good.groupBy("store").agg(F.count(F.lit(1)).alias("found"))
    facts = (
        gate.select("store", "aborted")
        .join(found, "store", "left")
        .join(cat.retirement_facts(merged, started_at), "store", "left")
        .join(q.count_dropped(fetch_log), "store", "left")
        .select(
            "store",
            F.lit(dry_run).alias("dry_run"),
            "aborted",
            F.lit(partial).alias("partial"),
            F.coalesce("pages_dropped", zero).alias("pages_dropped"),
            F.coalesce("found", zero).alias("found"),
            F.coalesce("missing", zero).alias("missing"),
        )
    )
    retire_gate = q.retirement_gate(facts)
    retired = cat.retire_products(merged, retire_gate, started_at)
    before = cat.unpriced_count(catalog, current).withColumnRenamed("unpriced", "unpriced_before")
    after = cat.unpriced_count(merged, published).withColumnRenamed("unpriced", "unpriced_after")
    errors = quarantine.groupBy("store").agg(F.count(F.lit(1)).alias("errors"))
    retirement = retire_gate.select(
        "store", F.when(F.col("retire_skip").isNull(), F.col("missing")).otherwise(zero).alias("retired"), "retire_skip"
    )
    report = q.run_report(gate, diff, fetch_log, retirement, before.join(after, "store", "full_outer"), errors)
    return PriceRun(retired, appended, pr.rejected_jumps(diff), published, quarantine, report)
