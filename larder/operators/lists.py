"""Saved lists: payloads, batches of saves, totals, drafts, drift, reads by owner.

``lists``: id, owner_id, name, is_archived, updated_at. ``items``: list_id, store_product_id, quantity decimal(10,3),
position, price_cop_at_add. ``profiles``: id, region_code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.fixed import LIST_MAX_ITEMS, LIST_MAX_NAME, LIST_MAX_QUANTITY, LIST_MIN_QUANTITY, NATIONAL
from larder.functions import money
from larder.functions.ordered import TARGET_ROWS, previous_row
from larder.functions.text import strip
from larder.operators.prices import prices_by_region, region_price
from larder.operators.save_chain import refused_saves
from larder.operators.save_replay import ITEM, LAST, VERDICT, replay_saves
from larder.session import cut_lineage

PAYLOAD = "array<struct<store_product_id string, quantity string>>"


def parse_list_items(saves: DataFrame, payload: str = "items", key: str = "save_id") -> DataFrame:
    """Explode a JSON payload to (key, store_product_id, quantity, position); a repeated product keeps its last entry."""
    entry = F.struct("position", F.col("item.quantity").try_cast("decimal(38,10)").alias("quantity"))
    # dealt as payloads, which are fewer and shorter than their entries
    return (
        saves.select(key, payload).repartition(key)
        .select(key, F.posexplode(F.from_json(payload, PAYLOAD)).alias("position", "item"))
        .groupBy(key, F.col("item.store_product_id").alias("store_product_id"))
        .agg(F.max(entry).alias("last"))
        .select(key, "store_product_id", F.col("last.quantity").alias("quantity"), F.col("last.position").alias("position"))
    )


def register_parse_list_items(spark) -> None:
    """The same as a SQL table function, for one payload in a lateral join: ``parse_list_items(json)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="store_product_id string, quantity string, position int")
    class ParseListItems:
        def eval(self, payload: str):
            import json

            last = {}
            for at, item in enumerate(json.loads(payload) if payload else []):
                last[item.get("store_product_id")] = (item.get("quantity"), at)
            for product, (quantity, at) in last.items():
                yield product, None if quantity is None else str(quantity), at

    spark.udtf.register("parse_list_items", ParseListItems)


def _own_error() -> Column:
    """Errors that need nothing but the save's own row."""
    entries = F.json_array_length("items")
    return (
        F.when(F.col("owner_id").isNull(), "42501")
        .when(entries.isNull() | (entries == 0), "22023")
        .when(entries > LIST_MAX_ITEMS, "54000")
        .when(F.coalesce(strip(F.col("name")), F.lit("")) == "", "23514")
        .when(F.length(strip(F.col("name"))) > LIST_MAX_NAME, "22001")
    )


def _outside() -> Column:
    """A quantity that no list may have."""
    low, high = F.lit(LIST_MIN_QUANTITY).cast("decimal(38,10)"), F.lit(LIST_MAX_QUANTITY).cast("decimal(38,10)")
    return F.coalesce((F.col("quantity") < low) | (F.col("quantity") > high), F.lit(True))


def _base_error(saves: DataFrame, entries: DataFrame) -> DataFrame:
    """Errors that need nothing but the save, today's prices and what its list holds.

    A product without a price can only be in a list that held it already: such saves are refused at once.
    """
    hopeless = F.col("today").isNull() & F.col("held_price").isNull()
    wrong = entries.groupBy("save_id").agg(F.max(_outside()).alias("_bad"), F.max(hopeless).alias("_hopeless"))
    code = _own_error().when(F.coalesce("_bad", F.lit(True)), "22003").when(F.col("_hopeless"), "P0001")
    return saves.join(wrong, "save_id", "left").withColumn("error", code).drop("_bad", "_hopeless")


def _list_error(checked: DataFrame, lists: DataFrame) -> DataFrame:
    """P0002 for a list that is missing, archived or another owner's; an earlier save of the batch may have made it."""
    known = lists.where(~F.col("is_archived")).select(F.col("id").alias("list_id"), F.col("owner_id").alias("_owner"))
    born = (
        checked.where("is_new and error is null")
        .groupBy("list_id")
        .agg(F.min(F.struct("seq", "owner_id")).alias("_born"))
    )
    there = F.col("_owner") == F.col("owner_id")
    made = (F.col("_born.seq") < F.col("seq")) & (F.col("_born.owner_id") == F.col("owner_id"))
    missing = ~F.col("is_new") & ~(F.coalesce(there, F.lit(False)) | F.coalesce(made, F.lit(False)))
    refused = F.col("error").isNull() | (F.col("error") == "P0001")
    return (
        checked.join(known, "list_id", "left")
        .join(born, "list_id", "left")
        .withColumn("error", F.when(refused & missing, "P0002").otherwise(F.col("error")))
        .drop("_owner", "_born")
    )


def _put_back(good: DataFrame, entries: DataFrame, target_rows: int) -> DataFrame:
    """Saves that have a product without a price today which the list no longer held when they came.

    ``entries`` holds each save's products with ``today`` and ``held_price``. Only lists where such a save is possible
    are followed, and of their saves only products without a price.
    """
    mine = entries.join(good.select("save_id"), "save_id", "left_semi")
    needed = mine.where("today is null").select("list_id", "store_product_id").distinct()
    product = F.col("store_product_id").cast("string")
    parts = (
        mine.join(needed, ["list_id", "store_product_id"], "left_semi")
        .groupBy("save_id")
        .agg(F.collect_list(F.when(F.col("today").isNull(), product)).alias("needs"), F.collect_list(product).alias("has"))
    )
    lists = needed.select("list_id").distinct()
    nothing = F.array().cast("array<string>")
    saves = good.select("save_id", "list_id", "seq").join(lists, "list_id", "left_semi").join(parts, "save_id", "left")
    held = (
        mine.where("held_price is not null")
        .join(needed, ["list_id", "store_product_id"], "left_semi")
        .groupBy("list_id")
        .agg(F.collect_set(product).alias("held"))
    )
    return refused_saves(
        saves.withColumns({"needs": F.coalesce("needs", nothing), "has": F.coalesce("has", nothing)}), held, target_rows
    )


def _join_list_saves(
    saves: DataFrame, entries: DataFrame, lists: DataFrame, items: DataFrame, target_rows: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saves with ``error``, items after and the last accepted save of each list, for lists of any number of saves.

    Saves are not replayed one by one: an entry is *continued* when the accepted save just before it on the same list
    has the product too, and the frozen price is today's if any entry started afresh, else the one the list already held.
    """
    columns = saves.columns
    held = items.select("list_id", "store_product_id", F.col("price_cop_at_add").alias("held_price"))
    entries = entries.join(held, ["list_id", "store_product_id"], "left")
    # read by the checks, the chain and the result: cut once instead of parsing every payload again
    entries = cut_lineage(entries)
    priced = _base_error(saves, entries)
    checked = cut_lineage(_list_error(priced, lists))
    earlier = entries.select(F.col("save_id").alias("before_id"), "store_product_id", F.lit(True).alias("_there"))

    def trace(good: DataFrame) -> DataFrame:
        chain = previous_row(
            good.select("save_id", "seq", "list_id"), ["list_id"], [F.col("seq")], F.col("seq"), ["save_id"], "before",
            target_rows,
        ).select("save_id", F.col("before.save_id").alias("before_id"))
        kept = F.when(F.col("before_id").isNull(), F.col("held_price").isNotNull()).otherwise(
            F.coalesce("_there", F.lit(False))
        )
        return (
            entries.join(chain, "save_id")
            .join(earlier, ["before_id", "store_product_id"], "left")
            .withColumn("continued", kept)
        )

    # What is left is a held product that lost its price, was taken out and put back within the batch.
    good = checked.where("error is null")
    late = cut_lineage(_put_back(good, entries, target_rows))
    good = good.join(late, "save_id", "left_anti")
    traced = trace(good)
    checked = (
        checked.join(late.withColumn("_late", F.lit(True)), "save_id", "left")
        .withColumn("error", F.coalesce("error", F.when(F.col("_late"), "P0001")))
        .drop("_late")
    )

    last = good.groupBy("list_id").agg(F.max_by(F.struct("save_id", "owner_id", "name"), "seq").alias("last"))
    frozen = traced.groupBy("list_id", "store_product_id").agg(
        F.max_by("today", F.when(~F.col("continued"), F.col("seq"))).alias("fresh_price"),
        F.max("held_price").alias("held_price"),
        F.max_by(F.struct("save_id", "quantity", "position"), "seq").alias("entry"),
    )
    kept = (
        frozen.join(last.select("list_id", F.col("last.save_id").alias("last_save")), "list_id")
        .where(F.col("entry.save_id") == F.col("last_save"))
        .select(
            "list_id",
            "store_product_id",
            F.col("entry.quantity").cast("decimal(10,3)").alias("quantity"),
            F.col("entry.position").alias("position"),
            F.coalesce("fresh_price", "held_price").cast("int").alias("price_cop_at_add"),
        )
    )
    untouched = items.join(last.select("list_id"), "list_id", "left_anti").select(*kept.columns)
    last = last.select("list_id", F.struct("last.owner_id", "last.name").alias("last"))
    return checked.select(*columns, "error"), untouched.unionByName(kept), last


def apply_list_saves(
    saves: DataFrame,
    lists: DataFrame,
    items: DataFrame,
    profiles: DataFrame,
    current: DataFrame,
    target_rows: int = TARGET_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a batch of saves in order; returns (saves with ``error``, items after, lists after).

    ``saves``: save_id, seq, owner_id, list_id, is_new, name, items (JSON). A product kept from one save to the next
    keeps its frozen price; one that was out in between takes today's. Each save stands or falls whole. The saves of a
    list are followed in one task; those of a list with more than ``target_rows`` of them are joined instead. Whatever
    is not asked for is not computed, and each of the three results that is, is computed on its own.
    """
    columns = saves.columns
    region = profiles.select(F.col("id").alias("owner_id"), "region_code")
    today = region_price(F.col("prices"), F.coalesce("region_code", F.lit(NATIONAL)))
    # the payloads' entries are many however small Spark takes them for, so they are never the side to broadcast
    entries = (
        parse_list_items(saves).hint("merge")
        .join(saves.select("save_id", "seq", "list_id", "owner_id").join(region, "owner_id", "left"), "save_id")
        .join(prices_by_region(current), "store_product_id", "left")
        .select("save_id", "seq", "list_id", "store_product_id", "quantity", "position", today.alias("today"))
    )
    long_lists = saves.groupBy("list_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows).select("list_id").collect()
    followed, joined = saves, None
    if long_lists:
        # at most one in target_rows of the saves, so the table is small
        known = saves.sparkSession.createDataFrame([(r[0],) for r in long_lists], f"_long {saves.schema['list_id'].dataType.simpleString()}")
        split = lambda df, how: df.join(F.broadcast(known), F.col("list_id").eqNullSafe(F.col("_long")), how)
        joined = _join_list_saves(*(split(df, "left_semi") for df in (saves, entries)), lists, split(items, "left_semi"), target_rows)
        followed, entries, items = (split(df, "left_anti") for df in (saves, entries, items))

    own = lists.where(~F.col("is_archived")).select(F.col("id").alias("list_id"), F.col("owner_id").alias("_owner"))
    there = F.coalesce(F.col("_owner") == F.col("owner_id"), F.lit(False))
    wanted = entries.withColumn("outside", _outside()).withColumn("price", F.col("today").cast("long")).drop("today")
    held = items.select(
        "list_id", F.col("store_product_id").cast("string").alias("store_product_id"),
        F.col("quantity").cast("decimal(38,10)").alias("quantity"), "position", F.col("price_cop_at_add").cast("long").alias("price"),
    )

    def replayed(out: int, row: list[str]) -> DataFrame:
        judged = followed.join(own, "list_id", "left").select(
            "list_id", "seq", "save_id", "owner_id", "is_new", _own_error().alias("code"), there.alias("there"), F.struct(*row).alias("row")
        )
        return replay_saves(judged, wanted, held).where(F.col("out") == out)

    verdicts = replayed(VERDICT, columns).select("row.*", "error")
    after = replayed(ITEM, ["owner_id"]).select(
        "list_id", "store_product_id", F.col("quantity").cast("decimal(10,3)").alias("quantity"), "position",
        F.col("price").cast("int").alias("price_cop_at_add"),
    )
    last = replayed(LAST, ["owner_id", "name"]).select("list_id", F.col("row").alias("last"))
    if joined:
        verdicts, after, last = verdicts.unionByName(joined[0]), after.unionByName(joined[1]), last.unionByName(joined[2])
    old_owner = lists.select(F.col("id").alias("list_id"), F.col("owner_id").alias("_owner"))
    renamed = last.join(old_owner, "list_id", "left").select(
        F.col("list_id").alias("id"),
        F.coalesce("_owner", "last.owner_id").alias("owner_id"),
        F.trim("last.name").alias("name"),
        F.lit(False).alias("is_archived"),
    )
    other = lists.join(last.select(F.col("list_id").alias("id")), "id", "left_anti").select(*renamed.columns)
    return verdicts, after, other.unionByName(renamed)


def list_totals(
    items: DataFrame, lists: DataFrame, profiles: DataFrame, products: DataFrame, current: DataFrame
) -> DataFrame:
    """Per list and store: items, today's subtotal (frozen price where none is left), and the subtotal at add.

    Lists of owners without a profile are dropped. Amounts are decimals rounded half up, item by item.
    """
    owner = lists.select(F.col("id").alias("list_id"), "owner_id").join(
        profiles.select(F.col("id").alias("owner_id"), "region_code"), "owner_id"
    )
    store = products.select(F.col("id").alias("store_product_id"), "store_id")
    today = F.coalesce(region_price(F.col("prices"), F.coalesce("region_code", F.lit(NATIONAL))), F.col("price_cop_at_add"))
    quantity = F.col("quantity").cast("decimal(10,3)")
    amount = lambda price: F.round(price.cast("decimal(12,0)") * quantity, 0)
    return (
        items.join(store, "store_product_id")
        .join(prices_by_region(current), "store_product_id", "left")
        .join(owner.select("list_id", "region_code"), "list_id")
        .groupBy("list_id", "store_id")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            F.sum(amount(today)).cast("bigint").alias("subtotal_cop"),
            F.sum(amount(F.col("price_cop_at_add"))).cast("bigint").alias("subtotal_at_add_cop"),
        )
    )


def list_summary(lists: DataFrame, totals: DataFrame) -> DataFrame:
    """Per list that is not archived: items, stores, total today and at add; an empty list shows zeros."""
    summed = totals.groupBy(F.col("list_id").alias("id")).agg(
        F.sum("item_count").alias("item_count"),
        F.count(F.lit(1)).alias("store_count"),
        F.sum("subtotal_cop").alias("total_cop"),
        F.sum("subtotal_at_add_cop").alias("total_at_add_cop"),
    )
    open_lists = lists.where(~F.col("is_archived"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return open_lists.join(summed, "id", "left").select(
        *open_lists.columns, zero("item_count"), zero("store_count"), zero("total_cop"), zero("total_at_add_cop")
    )


def draft_totals(draft: DataFrame) -> DataFrame:
    """Items and subtotal per draft and store with the grand total of the draft in one pass.

    ``draft``: draft_id, store_slug, store_name, price_cop, quantity. The grand total has ``store_slug`` null.
    """
    amount = F.col("price_cop").cast("decimal(12,0)") * F.col("quantity").cast("decimal(10,3)")
    return (
        draft.withColumn("store", F.struct("store_slug", "store_name"))
        .groupingSets([["draft_id", "store"], ["draft_id"]], "draft_id", "store")
        .agg(F.count(F.lit(1)).alias("item_count"), F.sum(amount).alias("subtotal"), F.grouping("store").alias("is_total"))
        .select(
            "draft_id",
            F.col("store.store_slug").alias("store_slug"),
            F.col("store.store_name").alias("store_name"),
            "item_count",
            F.col("subtotal").cast("decimal(20,3)").alias("subtotal_cop"),
            (F.col("is_total") == 1).alias("is_total"),
        )
    )


def item_drift(items: DataFrame, lists: DataFrame, profiles: DataFrame, current: DataFrame) -> DataFrame:
    """Each item's frozen price against today's: delta, direction, percent, and whether it has a price at all."""
    owner = lists.select(F.col("id").alias("list_id"), "owner_id").join(
        profiles.select(F.col("id").alias("owner_id"), "region_code"), "owner_id", "left"
    )
    frozen, today = F.col("price_cop_at_add"), F.col("today_cop")
    return (
        items.join(prices_by_region(current), "store_product_id", "left")
        .join(owner.select("list_id", "region_code"), "list_id")
        .withColumn("today_cop", region_price(F.col("prices"), F.coalesce("region_code", F.lit(NATIONAL))))
        .select(
            "list_id",
            "store_product_id",
            "quantity",
            "price_cop_at_add",
            "today_cop",
            money.change_delta(frozen, today).alias("delta_cop"),
            F.when(today.isNotNull(), money.change_direction(frozen, today)).alias("direction"),
            F.when(today.isNotNull(), money.change_percent(frozen, today)).alias("percent"),
            today.isNull().alias("no_price_today"),
        )
    )


def merge_draft(draft: DataFrame, kept: DataFrame, key: str = "draft_id") -> DataFrame:
    """Draft rows, plus the kept items the draft does not have."""
    columns = [key, "store_product_id", "quantity"]
    rest = kept.join(draft.select(key, "store_product_id"), [key, "store_product_id"], "left_anti")
    return draft.select(*columns).unionByName(rest.select(*columns))


def split_for_edit(items: DataFrame, priced: DataFrame) -> DataFrame:
    """Items that still have a price go to the draft, the others are kept aside; ``is_kept`` tells which."""
    known = priced.select(F.col("id").alias("store_product_id"), F.lit(False).alias("_kept")).distinct()
    return items.join(known, "store_product_id", "left").withColumn("is_kept", F.coalesce("_kept", F.lit(True))).drop("_kept")


def owned_by(
    owners: DataFrame, lists: DataFrame, items: DataFrame, reminders: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lists, items and reminders of the given owners (column ``owner_id``); items follow their list."""
    who = owners.select("owner_id").distinct()
    own_lists = lists.join(who, "owner_id", "left_semi")
    own_items = items.join(own_lists.select(F.col("id").alias("list_id")), "list_id", "left_semi")
    return own_lists, own_items, reminders.join(who, "owner_id", "left_semi")

