"""Catalogue queries: listing, search, summaries, equivalents.

``products``: id, store_id, external_id, ean, name, brand, category_id, unit_kind, unit_value, unit_measure, image_url,
is_available, last_seen_at. ``stores``: id, slug, name, logo_path, source_type, is_active. ``categories``: id, slug,
name, sort_order. Stores and categories are dimensions (eleven chains, thirty-nine aisles); their size is left to
Spark's own broadcast limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.fixed import MAX_TERM_LENGTH, MAX_TERMS, NATIONAL, SEARCH_PAGE
from larder.functions.text import fold
from larder.operators.prices import price_for_region, prices_by_region, region_price


def catalog_products(
    products: DataFrame, stores: DataFrame, categories: DataFrame, current: DataFrame, region: str
) -> DataFrame:
    """Products with a price for the region (or the national one). Unpriced ones are absent, unavailable ones are not."""
    shop = stores.select(F.col("id").alias("store_id"), F.col("slug").alias("store_slug"), F.col("name").alias("store_name"))
    aisle = categories.select(F.col("id").alias("category_id"), F.col("slug").alias("category_slug"))
    price = price_for_region(current, region).withColumnRenamed("store_product_id", "id")
    return products.join(price, "id").join(shop, "store_id").join(aisle, "category_id", "left")


def search_terms(text: Column) -> Column:
    """At most six folded words of at most thirty letters or digits."""
    found = F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.slice(F.transform(found, lambda w: F.left(w, F.lit(MAX_TERM_LENGTH))), 1, MAX_TERMS)


def name_tokens(name: Column, brand: Column) -> Column:
    """Distinct folded tokens of name and brand, split on anything but a-z and 0-9."""
    text = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(brand, F.lit("")))
    return F.array_distinct(F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: w != ""))


def prefixes(tokens: Column) -> Column:
    """Every distinct prefix of every token, one to thirty letters."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                tokens,
                lambda t: F.transform(
                    F.sequence(F.lit(1), F.least(F.length(t), F.lit(MAX_TERM_LENGTH))), lambda n: F.left(t, n)
                ),
            )
        )
    )


def search_products(
    requests: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    categories: DataFrame,
    current: DataFrame,
    page: int = SEARCH_PAGE,
) -> DataFrame:
    """Answer a table of searches: request_id, query, region_code, store_slug?, category_slug?, page_offset.

    The longest term of a request is looked up in the prefix index by an equality; the other terms are checked inside
    the row, so no shuffle counts matches. Requests without words share one ranking per set of filters.
    """
    shop = stores.select(F.col("id").alias("store_id"), F.col("slug").alias("p_store"))
    aisle = categories.select(F.col("id").alias("category_id"), F.col("slug").alias("p_category"))
    listed = (
        products.where("is_available")
        .join(prices_by_region(current).withColumnRenamed("store_product_id", "id"), "id")
        .join(shop, "store_id")
        .join(aisle, "category_id", "left")
        .select("id", "name", "brand", "p_store", "p_category", "prices")
    )
    asked = requests.select(
        "request_id",
        search_terms(F.col("query")).alias("terms"),
        F.coalesce("region_code", F.lit(NATIONAL)).alias("region_code"),
        "store_slug",
        "category_slug",
        F.coalesce("page_offset", F.lit(0)).alias("page_offset"),
    ).withColumn("lead", F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"])
    furthest = asked.agg(F.max("page_offset")).first()[0] or 0
    last_rank = int(furthest) + page
    price = region_price(F.col("prices"), F.col("region_code"))
    order = [F.collate("name", "UNICODE"), F.col("id")]

    with_words = asked.where("lead is not null")
    # Only prefixes somebody asked for leave the products: the distinct lead terms are few and Spark sizes that side.
    index = (
        listed.withColumn("tokens", name_tokens(F.col("name"), F.col("brand")))
        .withColumn("lead", F.explode(prefixes(F.col("tokens"))))
        .join(with_words.select("lead").distinct(), "lead", "left_semi")
    )
    every_term = F.forall("terms", lambda t: F.exists("tokens", lambda token: F.startswith(token, t)))
    same_store = F.col("store_slug").isNull() | (F.col("store_slug") == F.col("p_store"))
    same_aisle = F.col("category_slug").isNull() | (F.col("category_slug") == F.col("p_category"))
    found = (
        index.join(with_words, "lead")
        .where(every_term & same_store & same_aisle)
        .withColumn("price_cop", price)
        .where("price_cop is not null")
        .withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))
        .where(F.col("rank") <= last_rank)
        .select("request_id", "page_offset", "rank", "id", "name", "price_cop")
    )

    without = asked.where("lead is null")
    filters = without.select("region_code", "store_slug", "category_slug").distinct()
    scope = listed.withColumn(
        "scope",
        F.explode(
            F.array(
                F.struct(F.col("p_store").alias("s"), F.col("p_category").alias("c")),
                F.struct(F.col("p_store").alias("s"), F.lit(None).cast("string").alias("c")),
                F.struct(F.lit(None).cast("string").alias("s"), F.col("p_category").alias("c")),
                F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("c")),
            )
        ),
    ).dropDuplicates(["id", "scope"])
    shared = ["region_code", "store_slug", "category_slug"]
    ranked = (
        scope.join(
            filters, F.col("scope.s").eqNullSafe(F.col("store_slug")) & F.col("scope.c").eqNullSafe(F.col("category_slug"))
        )
        .withColumn("price_cop", price)
        .where("price_cop is not null")
        .withColumn("rank", F.row_number().over(Window.partitionBy(*shared).orderBy(*order)))
        .where(F.col("rank") <= last_rank)
    )
    same_filters = (
        (without.region_code == ranked.region_code)
        & without.store_slug.eqNullSafe(ranked.store_slug)
        & without.category_slug.eqNullSafe(ranked.category_slug)
    )
    everything = without.join(ranked, same_filters).select(
        "request_id", "page_offset", "rank", ranked.id, ranked.name, "price_cop"
    )
    on_page = (F.col("rank") > F.col("page_offset")) & (F.col("rank") <= F.col("page_offset") + page)
    return found.unionByName(everything).where(on_page).drop("page_offset")


def products_by_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """The listed products among ``ids`` (column ``id``); missing ones are simply absent."""
    return catalog.join(ids.select("id"), "id", "left_semi")


def _shown(products: DataFrame, current: DataFrame, region: str, national: str) -> DataFrame:
    """Available products that have a price in the region or the national one."""
    priced = current.where(F.col("region_code").isin(region, national)).select(F.col("store_product_id").alias("id"))
    return products.where("is_available").join(priced, "id", "left_semi")


def store_summary(
    stores: DataFrame, products: DataFrame, current: DataFrame, region: str, national: str = NATIONAL
) -> DataFrame:
    """One row per store, also those with nothing: products shown and the newest sighting among them.

    The semi join keeps one row per product, so a plain count is the distinct count; it is taken before the join.
    """
    counted = (
        _shown(products, current, region, national)
        .groupBy(F.col("store_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("product_count"), F.max("last_seen_at").alias("last_updated_at"))
    )
    return stores.join(counted, "id", "left").withColumn("product_count", F.coalesce("product_count", F.lit(0)))


def store_category_summary(
    stores: DataFrame,
    categories: DataFrame,
    products: DataFrame,
    current: DataFrame,
    region: str,
    national: str = NATIONAL,
) -> DataFrame:
    """Products shown per store and aisle; empty aisles are absent."""
    counted = (
        _shown(products, current, region, national)
        .where("category_id is not null")
        .groupBy("store_id", "category_id")
        .agg(F.count(F.lit(1)).alias("product_count"))
    )
    shop = stores.select(F.col("id").alias("store_id"), F.col("slug").alias("store_slug"))
    aisle = categories.select(
        F.col("id").alias("category_id"),
        F.col("slug").alias("category_slug"),
        F.col("name").alias("category_name"),
        "sort_order",
    )
    return counted.join(shop, "store_id").join(aisle, "category_id")


def counts_match_listing(summary: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stores whose summary and listing disagree; ``listed`` counts what a search without words would show."""
    listed = catalog.where("is_available").groupBy(F.col("store_id").alias("id")).agg(F.count(F.lit(1)).alias("listed"))
    counted = summary.select("id", F.col("product_count").alias("counted"))
    return (
        counted.join(listed, "id", "full_outer")
        .select("id", F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("listed", F.lit(0)).alias("listed"))
        .withColumn("mismatch", F.col("counted") - F.col("listed"))
    )


def with_freshness(summary: DataFrame, now: Column) -> DataFrame:
    """Hours and days since the last update, a label, and whether the store can be browsed."""
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_updated_at").cast("timestamp"))
    hours = F.floor(seconds / 3600).cast("bigint")
    days = F.floor(hours / 24).cast("bigint")
    label = (
        F.when(hours.isNull(), "Sin datos todavía")
        .when(hours < 1, "Precios de hace un momento")
        .when(hours < 24, F.concat(F.lit("Precios de hace "), hours.cast("string"), F.lit(" h")))
        .when(days == 1, "Precios de ayer")
        .otherwise(F.concat(F.lit("Precios de hace "), days.cast("string"), F.lit(" días")))
    )
    return summary.withColumns(
        {
            "hours_old": hours,
            "days_old": days,
            "freshness": label,
            "browsable": F.col("is_active") & (F.col("product_count") > 0),
        }
    )


def equivalents_by_ean(catalog: DataFrame) -> DataFrame:
    """Barcodes sold by two stores or more: how many, the price gap, and who is cheapest. All of it aggregates."""
    cheapest = F.min(F.struct("price_cop", "store_id", "id"))
    return (
        catalog.where("ean is not null")
        .groupBy("ean")
        .agg(
            F.count_distinct("store_id").alias("stores"),
            F.min("price_cop").alias("min_cop"),
            F.max("price_cop").alias("max_cop"),
            cheapest.alias("cheapest"),
        )
        .where("stores >= 2")
        .select(
            "ean",
            "stores",
            "min_cop",
            "max_cop",
            (F.col("max_cop") - F.col("min_cop")).alias("gap_cop"),
            F.col("cheapest.store_id").alias("cheapest_store_id"),
            F.col("cheapest.id").alias("cheapest_id"),
        )
    )


def equivalence_members(catalog: DataFrame) -> DataFrame:
    """(group_id, store_product_id, confidence) of the barcode groups, a fact rather than a suggestion."""
    groups = equivalents_by_ean(catalog).select("ean")
    return catalog.join(groups, "ean", "left_semi").select(
        F.col("ean").alias("group_id"), F.col("id").alias("store_product_id"), F.lit("ean").alias("confidence")
    )


def _shingles(text: Column) -> Column:
    """Distinct three-letter pieces of a text; a shorter text is one piece."""
    padded = F.rpad(text, F.greatest(F.length(text), F.lit(3)), F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.array_distinct(F.transform(starts, lambda i: F.substr(padded, i, F.lit(3))))


def equivalents_fuzzy(catalog: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Suggested equivalents: pairs of texts of one kind and size whose shingles have a Jaccard of ``threshold``.

    Products with the same text, kind and size are one group, linked by its id, so copies never pair up: a group whose
    members no barcode ties together is one row, with itself on both sides and a Jaccard of 1, its ``members``, how many
    different ``barcodes`` and ``stores`` they have. Between groups the join is exact but small: shingles are ranked from rare to common, and two sets that reach the threshold
    must share one of their ``n - ceil(t n) + 1`` rarest. Pairs already tied by a barcode are left out.
    """
    text = fold(F.concat_ws(" ", F.col("name"), F.coalesce("brand", F.lit(""))))
    block = F.concat_ws("|", F.coalesce("unit_kind", F.lit("")), F.coalesce(F.col("base_amount").cast("string"), F.lit("")))
    tagged = catalog.withColumn("block", block).withColumn("text", F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")))
    groups = (
        tagged.groupBy("block", "text")
        .agg(
            F.min("id").alias("group_id"),
            F.count(F.lit(1)).alias("members"),
            F.when(F.min("ean") == F.max("ean"), F.min("ean")).alias("ean"),
            F.count_distinct("ean").alias("barcodes"),
            F.count_distinct("store_id").alias("stores"),
            F.count("ean").alias("coded"),
        )
        .withColumn("shingles", _shingles(F.col("text")))
    )
    pieces = groups.select("block", "group_id", F.explode("shingles").alias("shingle"))
    counts = pieces.groupBy("block", "shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = (
        pieces.join(counts, ["block", "shingle"])
        .groupBy("block", "group_id")
        .agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("ranked"))
    )
    size = F.size("ranked")
    rare = F.slice("ranked", F.lit(1), size - F.ceil(F.lit(threshold) * size - F.lit(1e-9)).cast("int") + 1)
    keyed = ranked.select(
        "block", "group_id", F.transform("ranked", lambda p: p["shingle"]).alias("set"), F.explode(rare).alias("p")
    ).select("block", "group_id", "set", F.col("p.shingle").alias("shingle"))
    left, right = keyed.alias("a"), keyed.alias("b")
    big, small = F.size("a.set"), F.size("b.set")
    candidates = (
        left.join(right, ["block", "shingle"])
        .where("a.group_id < b.group_id")
        .where((big * threshold <= small + 1e-9) & (small * threshold <= big + 1e-9))
        .select(
            F.col("a.group_id").alias("group_a"), F.col("b.group_id").alias("group_b"), F.col("a.set").alias("sa"),
            F.col("b.set").alias("sb"),
        )
    )
    both = F.size(F.array_intersect("sa", "sb"))
    scored = (
        candidates.withColumn("jaccard", both / (F.size("sa") + F.size("sb") - both))
        .where(F.col("jaccard") >= threshold - 1e-9)
        .groupBy("group_a", "group_b")
        .agg(F.first("jaccard").alias("jaccard"))
    )
    label = groups.select("group_id", "text", "ean", "members")
    a = label.select(*[F.col(c).alias(f"{c}_a") for c in label.columns]).withColumnRenamed("group_id_a", "group_a")
    b = label.select(*[F.col(c).alias(f"{c}_b") for c in label.columns]).withColumnRenamed("group_id_b", "group_b")
    fact = F.coalesce(F.col("ean_a") == F.col("ean_b"), F.lit(False))
    pairs = scored.join(a, "group_a").join(b, "group_b").where(~fact).drop("ean_a", "ean_b")
    untied = groups.where((F.col("members") > 1) & ((F.col("barcodes") != 1) | (F.col("coded") < F.col("members"))))
    same = untied.select(
        F.col("group_id").alias("group_a"), F.col("group_id").alias("group_b"), F.lit(1.0).alias("jaccard"),
        F.col("text").alias("text_a"), F.col("members").alias("members_a"), F.col("text").alias("text_b"),
        F.col("members").alias("members_b"), "barcodes", "stores",
    )
    return pairs.unionByName(same, allowMissingColumns=True)
