"""Catalogue and shop upkeep: upsert, retire, unpriced. Rows are never deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import fixed
from larder.functions.ids import stable_id

SOURCE_COLUMNS = [
    "ean", "name", "brand", "category_id", "source_bucket", "unit_kind", "unit_value", "unit_measure", "image_url",
    "is_available",
]
CATALOG_COLUMNS = ["store_slug", "external_id", "id", *SOURCE_COLUMNS, "first_seen_at", "last_seen_at"]
BRANCH_SOURCE = ["name", "address", "city", "latitude", "longitude", "source"]
BRANCH_ALL = ["store_slug", "external_id", "id", *BRANCH_SOURCE, "is_active", "last_seen_at", "created_at"]
KEY = ["store_slug", "external_id"]


def _merge(current: DataFrame, fresh: DataFrame, replaced: list[str], kept: dict[str, Column], columns: list[str]) -> DataFrame:
    """Full outer join on the key: a row of the run replaces the source columns, the others stay as they were."""
    new = fresh.select(*KEY, *[F.col(c).alias(f"_new_{c}") for c in replaced], F.lit(True).alias("_seen"))
    merged = current.join(new, KEY, "full_outer")
    seen = F.coalesce("_seen", F.lit(False))
    return merged.select(
        *[
            (F.when(seen, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in replaced else kept.get(c, F.col(c))).alias(c)
            for c in columns
        ]
    )


def upsert_catalog(current: DataFrame, staging: DataFrame, categories: DataFrame, now: Column) -> DataFrame:
    """The catalogue after a run. Ids and first sightings are kept; an unknown aisle becomes null."""
    aisle = categories.select(F.col("id").alias("category_id"), F.col("slug").alias("category_slug"))
    fresh = staging.withColumnRenamed("store", "store_slug").join(aisle, "category_slug", "left").withColumn("last_seen_at", now)
    kept = {
        "id": F.coalesce("id", stable_id(F.col("store_slug"), F.col("external_id"))),
        "first_seen_at": F.coalesce("first_seen_at", now),
    }
    return _merge(current, fresh, [*SOURCE_COLUMNS, "last_seen_at"], kept, CATALOG_COLUMNS)


def product_id(store: str = "store", external_id: str = "external_id") -> Column:
    """The id a product gets the first time it is seen."""
    return stable_id(F.col(store), F.col(external_id))


def stale(started_at: Column, days: int = fixed.STALE_AFTER_DAYS) -> Column:
    return F.col("is_available") & (F.col("last_seen_at") < started_at - F.expr(f"interval {days} days"))


def retirement_facts(catalog: DataFrame, started_at: Column) -> DataFrame:
    """Per store: products available but unseen for three days."""
    return catalog.groupBy(F.col("store_slug").alias("store")).agg(F.count_if(stale(started_at)).alias("missing"))


def retire_products(catalog: DataFrame, gate: DataFrame, started_at: Column) -> DataFrame:
    """Mark stale products unavailable in the stores whose gate is open. ``gate``: store, retire_skip."""
    open_gate = gate.where("retire_skip is null").select(F.col("store").alias("store_slug"), F.lit(True).alias("_open"))
    gone = F.coalesce("_open", F.lit(False)) & stale(started_at)
    return (
        catalog.join(open_gate, "store_slug", "left")
        .withColumn("is_available", F.col("is_available") & ~F.coalesce(gone, F.lit(False)))
        .drop("_open")
    )


def upsert_branches(current: DataFrame, staging: DataFrame, now: Column) -> DataFrame:
    """Shops after a sweep; whatever was seen is active and official again."""
    fresh = staging.withColumnRenamed("store", "store_slug").withColumns(
        {"source": F.lit("official"), "is_active": F.lit(True), "last_seen_at": now}
    )
    kept = {
        "id": F.coalesce("id", stable_id(F.lit("branch"), F.col("store_slug"), F.col("external_id"))),
        "created_at": F.coalesce("created_at", now),
    }
    return _merge(current, fresh, [*BRANCH_SOURCE, "is_active", "last_seen_at"], kept, BRANCH_ALL)


def branch_retirement_facts(branches: DataFrame, started_at: Column) -> DataFrame:
    gone = F.col("is_active") & (F.col("last_seen_at") < started_at)
    return branches.groupBy(F.col("store_slug").alias("store")).agg(F.count_if(gone).alias("missing"))


def retire_branches(branches: DataFrame, gate: DataFrame, started_at: Column) -> DataFrame:
    """Mark shops the sweep did not see as closed, in the stores whose gate is open."""
    open_gate = gate.where("retire_skip is null").select(F.col("store").alias("store_slug"), F.lit(True).alias("_open"))
    gone = F.coalesce("_open", F.lit(False)) & F.col("is_active") & (F.col("last_seen_at") < started_at)
    return (
        branches.join(open_gate, "store_slug", "left")
        .withColumn("is_active", F.col("is_active") & ~F.coalesce(gone, F.lit(False)))
        .drop("_open")
    )


def unpriced_count(catalog: DataFrame, current: DataFrame) -> DataFrame:
    """Products of each store without a current price in any region, whether available or not."""
    priced = current.select(F.col("store_product_id").alias("id"))
    return (
        catalog.join(priced, "id", "left_anti").groupBy(F.col("store_slug").alias("store")).agg(F.count(F.lit(1)).alias("unpriced"))
    )
