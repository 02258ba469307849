"""Raw catalogue records to canonical rows, each ok, skipped (routine) or failed (unreadable)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import fixed
from larder.functions import money
from larder.functions.rules import fold_keyword
from larder.functions.text import fold, squeeze, strip, tidy_case
from larder.operators.classify import Taxonomy, aisle_of, plain_words
from larder.operators.measure import clean_brand, clean_name, display_name, erp_measure_of, measure_of
from larder.schemas import PRODUCT_COLUMNS


def dedupe_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order; ids are compared as trimmed text and null ids are all kept.

    The rank is limited to one, so every task sends at most one row per key to the shuffle, hot key or not.
    """
    names = [f"_key_{i}" for i in range(len(keys))]
    kinds = dict(rows.dtypes)
    as_text = lambda k: F.nullif(strip(F.col(k)), F.lit("")) if kinds[k] == "string" else F.col(k)
    keyed = rows.withColumns({n: as_text(k) for n, k in zip(names, keys)})
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    first = Window.partitionBy(*names).orderBy(*order)
    kept = keyed.where(known).withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    return kept.unionByName(keyed.where(~known)).drop(*names)


def truncated_aisles(page_log: DataFrame, aisle_map: DataFrame) -> DataFrame:
    """Fetch-log rows for aisles that still gave a full page at the paging ceiling: there was more to read."""
    last = page_log.groupBy("store", "aisle_id").agg(F.max(F.struct("page_no", "records", "url")).alias("last"))
    labels = aisle_map.select("store", "aisle_id", "label")
    return (
        last.where(
            (F.col("last.page_no") * fixed.PAGE_SIZE >= fixed.PAGE_CEILING) & (F.col("last.records") >= fixed.PAGE_SIZE)
        )
        .join(labels, ["store", "aisle_id"], "left")
        .select(
            F.col("last.url").alias("url"),
            "store",
            F.lit("dropped").alias("outcome"),
            F.concat(F.lit("aisle cut at the paging ceiling: "), F.coalesce("label", "aisle_id")).alias("reason"),
        )
    )


def _canonical_problem(row: dict[str, Column]) -> Column:
    """Why a finished row may not be stored, or null."""
    bad_price = lambda c: c.isNotNull() & ((c <= 0) | (c > fixed.MAX_PRICE_COP))
    return (
        F.when(F.coalesce(bad_price(row["price_cop"]), F.lit(False)), "price out of range")
        .when(F.coalesce(bad_price(row["list_price_cop"]), F.lit(False)), "list price out of range")
        .when(row["image_url"].isNotNull() & ~row["image_url"].rlike(fixed.URL), "image is not a url")
    )


def _finish(df: DataFrame, problem: Column, skip: Column, extra: Sequence[str]) -> DataFrame:
    """Keep provenance, canonical columns, and status with its reason; a refused row keeps only what identifies it."""
    row = {c: F.col(f"n_{c}") for c in PRODUCT_COLUMNS}
    verdict = F.struct(problem.alias("problem"), skip.alias("skip"))
    judged = df.withColumn("_v", verdict)
    ok = F.col("_v.problem").isNull() & F.col("_v.skip").isNull()
    late = _canonical_problem(row)
    status = F.when(F.col("_v.problem").isNotNull(), "failed").when(F.col("_v.skip").isNotNull(), "skipped").when(
        late.isNotNull(), "failed"
    )
    reason = F.coalesce("_v.problem", "_v.skip", F.when(ok, late))
    cast = {"price_cop": "int", "list_price_cop": "int", "unit_value": "decimal(10,3)"}
    return judged.select(
        *extra,
        F.coalesce(status, F.lit("ok")).alias("status"),
        reason.alias("reason"),
        *[(row[c].try_cast(cast[c]) if c in cast else row[c]).alias(c) for c in PRODUCT_COLUMNS],
    )


def normalize_vtex(
    raw: DataFrame,
    aisle_map: DataFrame,
    name_fields: Mapping[str, str] | None = None,
    taxonomy: Taxonomy = Taxonomy(),
) -> DataFrame:
    """Canonical rows of VTEX records. ``name_fields`` tells which name a chain shows; ``nameComplete`` by default."""
    buckets = aisle_map.select("store", "aisle_id", F.col("bucket").alias("n_source_bucket"), "aisle_ord")
    tagged = raw.join(buckets, ["store", "aisle_id"], "left")
    item = F.get(F.col("items"), F.lit(0))
    staged = tagged.withColumn("_item", item).withColumn(
        "_offer", F.get(F.col("_item.sellers"), F.lit(0))["commertialOffer"]
    )
    shows_product_name = [s for s, field in (name_fields or {}).items() if field == "productName"]
    own, full = F.col("productName"), F.col("_item.nameComplete")
    source_name = F.coalesce(full, own, F.lit(""))
    if shows_product_name:
        source_name = F.when(F.col("store").isin(*shows_product_name), F.coalesce(own, full, F.lit(""))).otherwise(
            source_name
        )
    staged = staged.withColumns(
        {
            "_source_name": source_name,
            "n_price_cop": money.to_cop(F.col("_offer.Price")),
            "_list": money.to_cop(F.col("_offer.ListPrice")),
            "n_external_id": strip(F.coalesce(F.col("productId").cast("string"), F.lit(""))),
        }
    )
    staged = staged.withColumns(
        {
            "n_name": display_name(F.col("_source_name"), F.col("brand")),
            "_size": measure_of(F.col("_source_name")),
            "n_brand": clean_brand(F.col("brand")),
            "n_list_price_cop": F.when(F.col("_list") > F.col("n_price_cop"), F.col("_list")),
            "n_ean": F.when(F.col("_item.ean").rlike(fixed.EAN), F.col("_item.ean")),
            "n_image_url": F.get(F.col("_item.images"), F.lit(0))["imageUrl"],
            "n_is_available": F.coalesce(F.col("_offer.IsAvailable"), F.lit(False))
            & (F.coalesce(F.col("_offer.AvailableQuantity"), F.lit(0)) > 0),
        }
    ).withColumn("_text", plain_words(F.col("n_name")))
    staged = staged.withColumns(
        {
            "n_category_slug": aisle_of(F.col("_text"), F.col("n_source_bucket"), taxonomy),
            "n_unit_kind": F.coalesce(money.lookup(F.col("_size.measure"), fixed.UNIT_KIND), F.lit("unit")),
            "n_unit_value": F.col("_size.value"),
            "n_unit_measure": F.col("_size.measure"),
        }
    )
    # the order of the tests matters: a sold-out record without an id is routine, not unreadable
    no_offer = F.col("_offer").isNull()
    priced = F.col("n_price_cop").isNotNull()
    problem = (
        F.when(no_offer, "no item or offer")
        .when(priced & (F.col("n_external_id") == ""), "no product id")
        .when(priced & (F.col("n_name") == ""), "no name")
    )
    skip = F.when(~no_offer & ~priced, "no price (sold out)")
    return _finish(staged, problem, skip, ["store", "aisle_id", "aisle_ord", "page_no", "pos"])


def _tags(col: Column) -> Column:
    """Tags come as a JSON array or as one text with commas; anything else is null, that is unreadable."""
    listed = F.filter(F.from_json(col, "array<string>"), lambda t: t.isNotNull())
    typed = F.filter(F.transform(F.split(col, ","), strip), lambda t: t != "")
    trimmed = strip(col)
    return F.when(trimmed.startswith("["), listed).when(~trimmed.startswith("{"), typed)


def label_key(col: Column) -> Column:
    return squeeze(F.upper(fold(col)))


Labels = Sequence[tuple[str, str | None]]


def _label_table(labels: Labels) -> Column:
    """Label -> (precedence, bucket) as one map literal; the first of two equal labels wins."""
    seen: dict[str, tuple[int, str | None]] = {}
    for at, (label, bucket) in enumerate(labels):
        key = " ".join(fold_keyword(label).upper().split())
        seen.setdefault(key, (at, bucket))
    entry = lambda at, bucket: F.struct(F.lit(at).alias("ord"), F.lit(bucket).cast("string").alias("bucket"))
    return F.map_from_arrays(F.array(*[F.lit(k) for k in seen]), F.array(*[entry(*v) for v in seen.values()]))


def aisle_from_tags(raw: DataFrame, tag_labels: Labels, type_labels: Labels) -> DataFrame:
    """Add ``aisle`` and ``aisle_found``: the tag that comes first in ``tag_labels``, else the product type.

    A found aisle may be null: the label is known and out of scope, which is not the same as no label at all. The
    tables are configuration and become literals, so nothing is exploded, joined or shuffled.
    """
    by_tag, by_type = _label_table(tag_labels), _label_table(type_labels)
    hits = F.transform(F.col("_tag_list"), lambda t: F.try_element_at(by_tag, label_key(t)))
    first = F.array_min(F.filter(hits, lambda h: h.isNotNull()))
    own = F.try_element_at(by_type, label_key(F.coalesce("product_type", F.lit(""))))
    return (
        raw.withColumn("_tag_list", _tags(F.col("tags")))
        .withColumn("_hit", F.coalesce(first, own))
        .withColumns({"aisle": F.col("_hit.bucket"), "aisle_found": F.col("_hit").isNotNull()})
        .drop("_hit")
    )


def normalize_shopify(
    raw: DataFrame, tag_labels: Labels, type_labels: Labels, taxonomy: Taxonomy = Taxonomy()
) -> DataFrame:
    """Canonical rows of Shopify records: prices are texts, titles shout, and the aisle hides among the tags."""
    variant = F.get(F.col("variants"), F.lit(0))
    staged = (
        aisle_from_tags(raw, tag_labels, type_labels)
        .withColumn("_variant", variant)
        .withColumns(
            {
                "n_external_id": strip(F.coalesce(F.col("id").cast("string"), F.lit(""))),
                "_title": strip(F.coalesce("title", F.lit(""))),
                "_readable": money.text_price_readable(F.col("_variant.price")),
                "n_price_cop": money.text_price(F.col("_variant.price")),
                "_list": money.text_price(F.col("_variant.compare_at_price")),
                "n_source_bucket": F.col("aisle"),
            }
        )
        .withColumn("_size", erp_measure_of(F.col("_title"), F.col("aisle")))
    )
    token = F.col("_size.token")
    at = F.instr(F.col("_title"), token)
    cut = F.concat(
        F.substr(F.col("_title"), F.lit(1), at - 1), F.lit(" "), F.substr(F.col("_title"), at + F.length(token))
    )
    hanging = rf"(?i)(^|{fixed.SPACE})(?:x|aprox\.?)(?={fixed.SPACE}|$)"
    loose = F.regexp_replace(F.replace(cut, F.lit("*"), F.lit(" ")), hanging, " ")
    shown = F.when(F.col("_size").isNotNull(), loose).otherwise(F.col("_title"))
    staged = staged.withColumn("_cleaned", clean_name(shown, F.col("vendor"))).withColumns(
        {
            "n_name": tidy_case(F.when(F.col("_cleaned") != "", F.col("_cleaned")).otherwise(F.col("_title"))),
            "n_brand": clean_brand(F.col("vendor")),
            "n_list_price_cop": F.when(F.col("_list") > F.col("n_price_cop"), F.col("_list")),
            "n_ean": F.when(strip(F.col("_variant.barcode")).rlike(fixed.EAN), strip(F.col("_variant.barcode"))),
            "n_image_url": F.when(F.get(F.col("images"), F.lit(0))["src"] != "", F.get(F.col("images"), F.lit(0))["src"]),
            "n_is_available": F.coalesce(F.col("_variant.available"), F.lit(False)),
            "n_unit_kind": F.coalesce(money.lookup(F.col("_size.measure"), fixed.UNIT_KIND), F.lit("unit")),
            "n_unit_value": F.col("_size.value"),
            "n_unit_measure": F.col("_size.measure"),
        }
    )
    staged = staged.withColumn("_text", plain_words(F.col("n_name"))).withColumn(
        "n_category_slug", aisle_of(F.col("_text"), F.col("n_source_bucket"), taxonomy)
    )
    unpriced = F.col("_readable") & F.col("n_price_cop").isNull()
    early = (
        F.when(F.col("n_external_id") == "", "no id")
        .when(F.col("_title") == "", "no title")
        .when(F.col("_variant").isNull(), "no variants")
        .when(~F.col("_readable"), "unreadable price")
    )
    problem = F.coalesce(early, F.when(~unpriced & F.col("_tag_list").isNull(), "unreadable tags"))
    skip = F.when(
        early.isNull(),
        F.when(unpriced, "no price")
        .when(F.col("aisle_found") & F.col("aisle").isNull(), "out of scope")
        .when(~F.col("aisle_found"), "no aisle in the source"),
    )
    return _finish(staged, problem, F.when(problem.isNull(), skip), ["store", "page_no", "pos"])

