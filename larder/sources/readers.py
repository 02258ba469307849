"""Landed pages to raw rows. A page is one file and stays small by the source's own page size.

Files lie in ``store=<slug>/.../page_no=<n>/`` folders; the folder columns come with every row. A file that is not the
expected JSON gives one row in the hole table instead of silently ending its listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schemas
from larder.functions.rules import MAX_RULES
from larder.functions.text import html_to_text, strip


def _pages(spark: SparkSession, path: str, folders: str) -> DataFrame:
    """One row per file: its text and its folder columns, typed by ``folders`` and never guessed."""
    return (
        spark.read.schema(f"value string, {folders}")
        .format("text")
        .option("wholetext", True)
        .load(path)
        .withColumn("url", F.col("_metadata.file_path"))
    )


def _list_of(record: str) -> Column:
    """A page that is a JSON list, else null: a lone object would be read as a list of one."""
    return F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", f"array<{record}>"))


def _holes(pages: DataFrame, store, reason: str) -> DataFrame:
    return pages.select("url", store.alias("store"), F.lit("dropped").alias("outcome"), F.lit(reason).alias("reason"))


def read_vtex_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw products, page log, holes) from ``store=/aisle_id=/page_no=`` folders of JSON arrays."""
    return vtex_pages(_pages(spark, path, "store string, aisle_id string, page_no int"))


def vtex_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from page texts (``value``). Records without an id are kept, so that they count as unreadable."""
    pages = pages.withColumn("body", _list_of(schemas.VTEX_PRODUCT))
    return _vtex_rows(pages), _vtex_log(pages), _holes(pages.where("body is null"), F.col("store"), "page is not a list")


def _vtex_rows(pages: DataFrame) -> DataFrame:
    return pages.select("store", "aisle_id", "page_no", F.posexplode("body").alias("pos", "product")).select(
        "store", "aisle_id", "page_no", "pos", "product.*"
    )


def _vtex_log(pages: DataFrame) -> DataFrame:
    return pages.select("url", "store", "aisle_id", "page_no", F.coalesce(F.size("body"), F.lit(0)).alias("records"))


def read_shopify_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(raw products, holes) from ``store=/page_no=`` folders of ``{products: [...]}`` pages."""
    return shopify_pages(_pages(spark, path, "store string, page_no int"))


def shopify_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from page texts (``value``)."""
    pages = pages.withColumn("body", F.from_json("value", f"struct<products array<{schemas.SHOPIFY_PRODUCT}>>")["products"])
    rows = pages.select("store", "page_no", F.posexplode("body").alias("pos", "product")).select(
        "store", "page_no", "pos", "product.*"
    )
    return rows, _holes(pages.where("body is null"), F.col("store"), "page without products")


def read_pickup_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw points, page log, holes) from ``store=/point=/page_no=`` folders; coordinates are longitude, latitude."""
    return pickup_pages(_pages(spark, path, "store string, point string, page_no int"))


def pickup_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from page texts (``value``)."""
    pages = pages.withColumn("body", F.from_json("value", schemas.PICKUP_PAGE))
    rows = (
        pages.select("store", "point", "page_no", F.posexplode("body.items").alias("pos", "item"))
        .where("item.pickupPoint is not null")
        .select("store", "point", "page_no", "pos", F.col("item.pickupPoint").alias("raw"))
    )
    log = pages.select("url", "store", "point", "page_no", F.col("body.paging.total").alias("total"))
    unread = pages.where("body.items is null and not (body.paging.total <=> 0)")
    return rows, log, _holes(unread, F.col("store"), "page without items")


def read_locator(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Raw shops (store, pos, raw) of a locator list: ``ara`` is a plain array, ``dollarcity`` wraps its list."""
    pages = spark.read.format("text").option("wholetext", True).load(path).withColumn("url", F.col("_metadata.file_path"))
    return locator_pages(pages, source)


def locator_pages(pages: DataFrame, source: str) -> DataFrame:
    """The same from page texts (``value``)."""
    if source == "ara":
        body = _list_of(schemas.ARA_SHOP)
    elif source == "dollarcity":
        body = F.from_json("value", schemas.DOLLARCITY_PAGE)["StoreLocations"]
    else:
        raise ValueError(f"no locator format for {source}")
    return pages.select(F.lit(source).alias("store"), "url", F.posexplode(body).alias("pos", "raw"))


def read_wp_shops(spark: SparkSession, shops: str, towns: str, departments: str) -> DataFrame:
    """Shops with the names of their first town and first department term; a shop without terms keeps nulls."""
    text = lambda path: spark.read.format("text").option("wholetext", True).load(path)
    return wp_pages(text(shops), text(towns), text(departments))


def wp_pages(shops: DataFrame, towns: DataFrame, departments: DataFrame) -> DataFrame:
    """The same from page texts (``value``)."""
    terms = lambda pages: pages.select(F.inline(F.from_json("value", f"array<{schemas.WP_TERM}>"))).select(
        "id", html_to_text(F.col("name")).alias("name")
    ).dropDuplicates(["id"])
    town = terms(towns).select(F.col("id").alias("town_id"), F.col("name").alias("municipality"))
    department = terms(departments).select(F.col("id").alias("department_id"), F.col("name").alias("department"))
    raw = shops.select(F.posexplode(F.from_json("value", f"array<{schemas.WP_SHOP}>")).alias("pos", "raw"))
    tagged = raw.select(
        F.lit("isimo").alias("store"),
        "pos",
        "raw",
        F.get(F.col("raw.tiendas-municipios"), F.lit(0)).alias("town_id"),
        F.get(F.col("raw.tiendas-departamento"), F.lit(0)).alias("department_id"),
    )
    return (
        tagged.join(town, "town_id", "left").join(department, "department_id", "left").drop("town_id", "department_id")
    )


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """Rows of curated shop files in ``store=`` folders; a file must name its source, date and coordinates."""
    return curated_pages(_pages(spark, path, "store string"))


def curated_pages(pages: DataFrame) -> DataFrame:
    """The same from page texts (``value``)."""
    pages = pages.withColumn("body", F.from_json("value", schemas.CURATED_FILE))
    whole = (
        (strip(F.col("body.source")) != "")
        & F.col("body.verifiedAt").try_cast("date").isNotNull()
        & (strip(F.col("body.coordinates")) != "")
        & (F.size("body.branches") > 0)
    )
    good = F.when(F.coalesce(whole, F.lit(False)), F.col("body.branches")).otherwise(
        F.raise_error(F.concat(F.lit("curated file without source, date, coordinates or shops: "), F.col("url")))
    )
    return pages.select("store", F.posexplode(good).alias("pos", "raw"))


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FETCH_LOG).json(path)


def read_aisle_map(spark: SparkSession, path: str) -> DataFrame:
    """Source aisles and our bucket for each, in the order that decides which aisle of a product comes first."""
    return spark.read.schema("store string, aisle_id string, label string, bucket string, aisle_ord int").json(path)


def read_label_map(spark: SparkSession, path: str) -> list[tuple[str, str | None]]:
    """Tag or type labels and our bucket (null: out of scope), in order of precedence; configuration, so small."""
    table = spark.read.schema("label string, bucket string, ord int").json(path)
    rows = table.orderBy("ord").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} labels: this is a configuration table, not data")
    return [(r["label"], r["bucket"]) for r in rows]


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 200) -> DataFrame:
    """Landed pages as a stream of raw products; same rows as ``read_vtex_pages``."""
    pages = (
        spark.readStream.schema("value string, store string, aisle_id string, page_no int")
        .format("text")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
        .withColumn("body", _list_of(schemas.VTEX_PRODUCT))
    )
    return _vtex_rows(pages)
