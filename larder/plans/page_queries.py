"""Registered queries: landed pages of every shape, written from the given tables, and read to rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.plans import views as v
from larder.plans.registry import query
from larder.sources import readers


def _paged(rows: DataFrame, keys: list[str], order: str, record: Column, wrap=lambda records: records) -> DataFrame:
    """A page text (``value``) per key: an order's few lines or a customer's own record, in their order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), record.alias("record"))))
    return rows.groupBy(*keys).agg(wrap(F.transform(ordered, lambda x: x["record"])).alias("body")).withColumn("value", F.to_json("body"))


def _vtex(spark, sf):
    """An order is a page, its lines the products; pages of finished orders are not lists."""
    lines = v.read(spark, sf, "lineitem").join(v.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    offer = F.struct(F.col("l_extendedprice").alias("Price"), (F.col("l_linenumber") > 1).alias("IsAvailable"), F.col("l_quantity").cast("long").alias("AvailableQuantity"))
    item = F.struct(F.concat(F.lit("77"), F.col("l_partkey").cast("string")).alias("ean"), F.array(F.struct(offer.alias("commertialOffer"))).alias("sellers"))
    # every third id is a number in the source
    product = F.struct(F.col("l_partkey").cast("string").alias("productId"), F.concat(F.lit("Ítem \"a\" "), F.col("l_suppkey").cast("string")).alias("productName"),
                       F.array(item).alias("items"), F.lit("x").alias("unknown"))
    pages = _paged(lines, ["o_orderkey", "o_orderstatus"], "l_linenumber", product)
    number = F.regexp_replace("value", r'"productId":"([0-9]*[369])"', r'"productId":$1')
    return readers.vtex_pages(pages.select(
        F.col("o_orderkey").cast("string").alias("url"), F.lit("exito").alias("store"), (F.col("o_orderkey") % 7).cast("string").alias("aisle_id"),
        F.col("o_orderkey").alias("page_no"), F.when(F.col("o_orderstatus") == "F", '{"error":"busy"}').otherwise(number).alias("value"),
    ))


@query(
    "landed_vtex",
    """select l_orderkey as page_no, (l_orderkey%7)::varchar as aisle_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey::varchar, l_suppkey::varchar, l_extendedprice)-1 as pos,
       l_partkey::varchar as product_id, 'Ítem "a" '||l_suppkey as name, '77'||l_partkey as ean, l_extendedprice as price, l_linenumber>1 as available,
       l_quantity::bigint as quantity from lineitem join orders on o_orderkey=l_orderkey where o_orderstatus<>'F'""",
)
def landed_vtex(spark, sf):
    offer = F.col("items")[0]["sellers"][0]["commertialOffer"]
    return _vtex(spark, sf)[0].select(
        "page_no", "aisle_id", "pos", F.col("productId").alias("product_id"), F.col("productName").alias("name"), F.col("items")[0]["ean"].alias("ean"),
        offer["Price"].alias("price"), offer["IsAvailable"].alias("available"), offer["AvailableQuantity"].alias("quantity"))


@query(
    "landed_vtex_log",
    """select l_orderkey::varchar as url, case when any_value(o_orderstatus)='F' then 0 else count(*) end as records,
       case when any_value(o_orderstatus)='F' then 'page is not a list' end as reason from lineitem join orders on o_orderkey=l_orderkey group by l_orderkey""",
)
def landed_vtex_log(spark, sf):
    _, log, holes = _vtex(spark, sf)
    return log.select("url", "records").join(holes.select("url", "reason"), "url", "left")


def _shopify(spark, sf):
    """A supplier's country is a page; one country's page has no products."""
    rows = v.read(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    variant = F.struct(F.format_string("%.2f", F.abs("s_acctbal")).alias("price"), (F.col("s_suppkey") % 2 == 0).alias("available"), none.alias("barcode"))
    product = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.array(F.lit("A, b"), F.col("s_name")).alias("tags"), F.array(variant).alias("variants"))
    pages = _paged(rows, ["s_nationkey"], "s_suppkey", product, lambda x: F.struct(F.when(F.col("s_nationkey") != 3, x).alias("products")))
    return readers.shopify_pages(pages.select(F.col("s_nationkey").cast("string").alias("url"), F.lit("supermu").alias("store"), F.col("s_nationkey").alias("page_no"), "value"))


@query(
    "landed_shopify",
    """select s_nationkey as page_no, row_number() over (partition by s_nationkey order by s_suppkey)-1 as pos, s_suppkey::varchar as id, s_name as title,
       '["A, b","'||s_name||'"]' as tags, printf('%.2f', abs(s_acctbal)) as price, s_suppkey%2=0 as available, null::varchar as reason
       from supplier where s_nationkey<>3
       union all select s_nationkey, null, null, null, null, null, null, 'page without products' from supplier where s_nationkey=3 group by 1""",
)
def landed_shopify(spark, sf):
    rows, holes = _shopify(spark, sf)
    found = rows.select("page_no", "pos", "id", "title", "tags", F.col("variants")[0]["price"].alias("price"), F.col("variants")[0]["available"].alias("available"))
    lost = holes.select(F.col("url").cast("int").alias("page_no"), "reason")
    return found.unionByName(lost, allowMissingColumns=True)


def _pickup(spark, sf):
    """A customer is a page of one point; some have no point, some pages no items though they promise one."""
    point = F.struct(F.col("c_name").alias("id"), F.col("c_mktsegment").alias("friendlyName"),
                     F.struct(F.array(F.lit(-74.5), F.col("c_acctbal") / 1000).alias("geoCoordinates")).alias("address"))
    item = F.struct(F.lit(1.5).alias("distance"), F.when(F.col("c_nationkey") != 5, point).alias("pickupPoint"))
    total = F.when(F.col("c_nationkey") == 7, 0).otherwise(F.col("c_custkey") % 40)
    page = F.struct(F.struct(F.lit(1).alias("page"), total.alias("total")).alias("paging"), F.when(~F.col("c_nationkey").isin(6, 7), F.array(item)).alias("items"))
    return readers.pickup_pages(v.read(spark, sf, "customer").select(
        F.col("c_name").alias("url"), F.lit("d1").alias("store"), F.col("c_custkey").cast("string").alias("point"), F.lit(1).alias("page_no"), F.to_json(page).alias("value")))


@query(
    "landed_pickup",
    """select c_custkey::varchar as point, case when c_nationkey=7 then 0 else c_custkey%40 end as total, case when c_nationkey not in (5,6,7) then c_name end as id,
       case when c_nationkey not in (5,6,7) then c_acctbal/1000 end as latitude, case when c_nationkey=6 and c_custkey%40<>0 then 'page without items' end as reason from customer""",
)
def landed_pickup(spark, sf):
    rows, log, holes = _pickup(spark, sf)
    found = rows.select("point", F.col("raw.id").alias("id"), F.col("raw.address.geoCoordinates")[1].alias("latitude"))
    return log.select("url", "point", F.col("total").cast("long").alias("total")).join(found, "point", "left").join(holes.select("url", "reason"), "url", "left").drop("url")


@query(
    "landed_locators",
    """select 'ara' as store, row_number() over (partition by c_nationkey order by c_custkey)-1 as pos, c_custkey::varchar as id, c_name as name, c_nationkey as nation from customer
       union all select 'dollarcity', row_number() over (partition by c_nationkey order by c_custkey)-1, c_custkey::varchar, c_name, c_nationkey from customer""",
)
def landed_locators(spark, sf):
    """A nation is a page: a plain list of one source, a wrapped one of the other."""
    customer = v.read(spark, sf, "customer")
    nation = F.col("c_nationkey").cast("string")
    ara = F.struct(F.col("c_custkey").cast("string").alias("store_code"), F.col("c_name").alias("name"), nation.alias("city"))
    dollar = F.struct(F.col("c_custkey").cast("string").alias("LocationId"), F.col("c_name").alias("Name"), nation.alias("Address"))
    lists = _paged(customer, ["c_nationkey"], "c_custkey", ara).select(F.lit("p").alias("url"), "value")
    wrapped = _paged(customer, ["c_nationkey"], "c_custkey", dollar, lambda x: F.struct(x.alias("StoreLocations"))).select(F.lit("p").alias("url"), "value")
    a = readers.locator_pages(lists, "ara").select("store", "pos", F.col("raw.store_code").alias("id"), F.col("raw.name").alias("name"), F.col("raw.city").cast("int").alias("nation"))
    b = readers.locator_pages(wrapped, "dollarcity").select("store", "pos", F.col("raw.LocationId").alias("id"), F.col("raw.Name").alias("name"), F.col("raw.Address").cast("int").alias("nation"))
    return a.unionByName(b)


@query(
    "landed_wp",
    """select c_custkey as id, c_name||' & co' as title, case when c_mktsegment<>'BUILDING' then n_name||' «x»' end as municipality,
       case when c_custkey%3>0 and r_regionkey<>2 then r_name end as department from customer join nation on n_nationkey=c_nationkey join region on r_regionkey=n_regionkey""",
)
def landed_wp(spark, sf):
    """A customer is a shop, its nation the first town term, its region the first department term; some terms are missing."""
    nation, region = v.read(spark, sf, "nation"), v.read(spark, sf, "region").where("r_regionkey <> 2")
    home = v.read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    shop = F.array(F.struct(
        F.col("c_custkey").alias("id"), F.struct(F.concat("c_name", F.lit(" & co")).alias("rendered")).alias("title"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.array("n_nationkey", F.lit(0))).alias("tiendas-municipios"),
        F.when(F.col("c_custkey") % 3 > 0, F.array(F.col("n_regionkey") + 100)).otherwise(F.array().cast("array<int>")).alias("tiendas-departamento")))
    towns = nation.select(F.to_json(F.array(F.struct(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(" &#171;x&#187;")).alias("name")))).alias("value"))
    departments = region.select(F.to_json(F.array(F.struct((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name")))).alias("value"))
    rows = readers.wp_pages(home.select(F.to_json(shop).alias("value")), towns, departments)
    return rows.select(F.col("raw.id").alias("id"), F.col("raw.title.rendered").alias("title"), "municipality", "department")


@query(
    "landed_curated",
    """select 'n'||c_nationkey as store, row_number() over (partition by c_nationkey order by c_custkey)-1 as pos, c_name as external_id, c_acctbal as latitude from customer""",
)
def landed_curated(spark, sf):
    """A nation is a curated file with its source, date and kind of coordinates."""
    branch = F.struct(F.col("c_name").alias("externalId"), F.col("c_acctbal").alias("latitude"))
    head = lambda x: F.struct(F.lit("own visit").alias("source"), F.lit("2026-05-01").alias("verifiedAt"), F.lit("gps").alias("coordinates"), x.alias("branches"))
    pages = _paged(v.read(spark, sf, "customer"), ["c_nationkey"], "c_custkey", branch, head)
    pages = pages.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("store"), F.lit("p").alias("url"), "value")
    return readers.curated_pages(pages).select("store", "pos", F.col("raw.externalId").alias("external_id"), F.col("raw.latitude").alias("latitude"))
