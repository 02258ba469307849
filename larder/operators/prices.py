"""Price history: latest, resolved, changed, as of a date, per unit, compacted, published.

``snapshots``: id, store_product_id, region_code, price_cop, list_price_cop, captured_at (append only).
``current``:   store_product_id, region_code, price_cop, list_price_cop, captured_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.fixed import KEEP_ALL_DAYS, NATIONAL
from larder.functions import money
from larder.functions.ordered import TARGET_ROWS, last_known, previous_row

KEY = ("store_product_id", "region_code")
CURRENT = (*KEY, "price_cop", "list_price_cop", "captured_at")


def _micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def latest_price(snapshots: DataFrame) -> DataFrame:
    """Last row per product and region; equal times go to the higher id.

    A max over a struct combines on the map side, so a product with a third of all rows sends one row per task.
    """
    last = F.max(F.struct("captured_at", "id", "price_cop", "list_price_cop"))
    return snapshots.groupBy(*KEY).agg(last.alias("last")).select(
        *KEY, "last.price_cop", "last.list_price_cop", "last.captured_at"
    )


def prices_by_region(current: DataFrame) -> DataFrame:
    """One row per product with a map region -> price; its size is that of the region dimension."""
    entry = F.struct("region_code", F.col("price_cop").alias("price"))
    return current.groupBy("store_product_id").agg(F.map_from_entries(F.collect_list(entry)).alias("prices"))


def region_price(prices: Column, region: Column) -> Column:
    """The region's price, else the national one, else null."""
    return F.coalesce(F.try_element_at(prices, region), F.try_element_at(prices, F.lit(NATIONAL)))


def price_for_region(current: DataFrame, region: str, national: str = NATIONAL) -> DataFrame:
    """Resolved price of every product for one region; products with neither price are absent."""
    return (
        current.where(F.col("region_code").isin(region, national))
        .groupBy("store_product_id")
        .agg(F.max_by("price_cop", F.col("region_code") == region).alias("price_cop"))
    )


def resolve_price(requests: DataFrame, current: DataFrame, national: str = NATIONAL) -> DataFrame:
    """Add ``price_cop`` to rows of (store_product_id, region_code): own region, else national, else null."""
    prices = prices_by_region(current)
    own = F.try_element_at("prices", F.coalesce(F.col("region_code"), F.lit(national)))
    resolved = F.coalesce(own, F.try_element_at(F.col("prices"), F.lit(national)))
    return requests.join(prices, "store_product_id", "left").select(
        *[requests[c] for c in requests.columns], resolved.alias("price_cop")
    )


def diff_prices(staging: DataFrame, current: DataFrame, region: str) -> DataFrame:
    """Compare the run's prices with the same region's published ones.

    ``decision``: new, changed, same or jump. Only new and changed are appended; the row of a jump is kept apart.
    """
    known = current.where(F.col("region_code") == region).select(
        "store_product_id", F.col("price_cop").alias("previous_cop")
    )
    decision = (
        F.when(F.col("previous_cop").isNull(), "new")
        .when(F.col("previous_cop") == F.col("price_cop"), "same")
        .when(money.is_jump(F.col("previous_cop"), F.col("price_cop")), "jump")
        .otherwise("changed")
    )
    return (
        staging.join(known, "store_product_id", "left")
        .withColumn("region_code", F.lit(region))
        .withColumn("decision", decision)
    )


def to_append(diff: DataFrame, captured_at: Column) -> DataFrame:
    """The snapshot rows a run may add; ids come from the key and the time, so a rerun repeats them."""
    return diff.where(F.col("decision").isin("new", "changed")).select(
        F.xxhash64("store_product_id", "region_code", captured_at).alias("id"),
        "store_product_id",
        "region_code",
        "price_cop",
        "list_price_cop",
        captured_at.alias("captured_at"),
    )


def rejected_jumps(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("decision") == "jump").select(
        "store_product_id", "region_code", "previous_cop", "price_cop"
    )


def publish(current: DataFrame, appended: DataFrame) -> DataFrame:
    """New current prices from the published ones and what the run appended, without reading the history."""
    old = current.select(F.lit(None).cast("bigint").alias("id"), *CURRENT)
    return latest_price(old.unionByName(appended.select("id", *CURRENT)))


def publish_rows(current: DataFrame, appended: DataFrame) -> DataFrame:
    """As ``publish``, of prices that keep the id of their snapshot: what comes out doesn't depend on the order of the runs."""
    rows = current.select("id", *CURRENT).unionByName(appended.select("id", *CURRENT))
    last = F.max(F.struct("captured_at", "id", "price_cop", "list_price_cop"))
    return rows.groupBy(*KEY).agg(last.alias("last")).select(
        "last.id", *KEY, "last.price_cop", "last.list_price_cop", "last.captured_at"
    )


def price_as_of(snapshots: DataFrame, points: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``points`` (store_product_id, region_code, as_of, ...) with the last price at or before ``as_of``."""
    extra = [c for c in points.columns if c not in (*KEY, "as_of")]
    seen = snapshots.select(
        *KEY,
        _micros(F.col("captured_at")).alias("_at"),
        F.lit(0).alias("_point"),
        F.col("id").alias("_id"),
        F.struct("price_cop", "captured_at").alias("_seen"),
    )
    asked = points.select(
        *KEY, _micros(F.col("as_of")).alias("_at"), F.lit(1).alias("_point"), F.struct("as_of", *extra).alias("_asked")
    )
    line = seen.unionByName(asked, allowMissingColumns=True)
    order = [F.col("_at"), F.col("_point"), F.col("_id"), F.col("_seen.price_cop")]
    known = last_known(line, KEY, order, F.col("_at"), F.col("_seen"), "_known", target_rows)
    return known.where("_point = 1").select(
        *KEY,
        "_asked.*",
        F.col("_known.price_cop").alias("price_cop"),
        F.col("_known.captured_at").alias("captured_at"),
    )


def price_changes(snapshots: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Every snapshot with the step from the one before: delta, direction, whole percent."""
    order = [_micros(F.col("captured_at")), F.col("id"), F.col("price_cop")]
    stepped = previous_row(snapshots, KEY, order, order[0], ["price_cop"], "_before", target_rows)
    before, now = F.col("_before.price_cop"), F.col("price_cop")
    return stepped.select(
        *snapshots.columns,
        before.alias("previous_cop"),
        money.change_delta(before, now).alias("delta_cop"),
        F.when(before.isNotNull(), money.change_direction(before, now)).alias("direction"),
        money.change_percent(before, now).alias("percent"),
    )


def unit_price(products: DataFrame) -> DataFrame:
    """Price per 100 g, 100 ml or unit beside each product; null without a measure."""
    price = money.unit_price(F.col("price_cop"), F.col("unit_value"), F.col("unit_measure"))
    known = price.isNotNull()
    return products.withColumns(
        {
            "unit_price_cop": price,
            "per_amount": F.when(known, money.per_amount(F.col("unit_measure"))),
            "base_measure": F.when(known, money.base_measure(F.col("unit_measure"))),
        }
    )


def compact_history(snapshots: DataFrame, today: Column) -> DataFrame:
    """All rows of the last 90 days; before that the first and last of each month, and always the newest.

    First and last are aggregates, so no product's history is ever gathered in one task.
    """
    columns = snapshots.columns
    row = F.struct("captured_at", "id", *[c for c in columns if c not in ("captured_at", "id")])
    fresh = F.col("captured_at").cast("date") > F.date_sub(today, KEEP_ALL_DAYS)
    month = F.date_trunc("month", F.col("captured_at")).alias("_month")
    monthly = snapshots.where(~fresh).groupBy(*KEY, month).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    # The newest row of all is recent or the last of its month, so it is always among the kept ones.
    old = monthly.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("row"))
    kept_old = old.select(*[F.col(f"row.{c}").alias(c) for c in columns])
    return snapshots.where(fresh).select(*columns).unionByName(kept_old)


def storage_estimate(snapshots: DataFrame, products: DataFrame) -> DataFrame:
    """Rows and estimated bytes of catalogue and history by store and month."""
    text_bytes = F.lit(0)
    for name, kind in products.dtypes:
        width = F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8)
        text_bytes = text_bytes + width
    catalogue = products.groupBy("store_id", F.date_format("first_seen_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(text_bytes).cast("bigint").alias("bytes")
    )
    by_product = snapshots.groupBy("store_product_id", F.date_format("captured_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length("region_code") + F.lit(32)).cast("bigint").alias("bytes"),
    )
    owner = products.select(F.col("id").alias("store_product_id"), "store_id")
    history = (
        by_product.join(owner, "store_product_id")
        .groupBy("store_id", "month")
        .agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    )
    return catalogue.select(F.lit("catalogue").alias("part"), "*").unionByName(
        history.select(F.lit("history").alias("part"), "*")
    )
