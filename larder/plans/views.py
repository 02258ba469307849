"""The driver's tables seen as the tables of this library, in Spark and as SQL fragments.

part = product, brand = store, p_type = aisle, lineitem = price observation and list item, orders = list,
customer = owner, line number = price region (the first is the national one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import apply_settings, spread


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    apply_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """For row rules that cost more than the scan: only the columns they need, over every core."""
    return spread(read(spark, sf_dir, table).select(*columns))


def _region(number: str):
    return F.when(F.col(number) == 1, "NACIONAL").otherwise(F.concat(F.lit("R"), F.col(number).cast("string")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5)
    shelf = F.floor(F.col("l_extendedprice") * (1 + F.col("l_tax")) / F.col("l_quantity") + 0.5)
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("store_product_id"),
        _region("l_linenumber").alias("region_code"),
        price.cast("int").alias("price_cop"),
        shelf.cast("int").alias("list_price_cop"),
        F.col("l_shipdate").cast("timestamp").alias("captured_at"),
    )


SNAP = """snap as (select l_orderkey*8+l_linenumber as id, l_partkey as store_product_id,
  case when l_linenumber=1 then 'NACIONAL' else 'R'||l_linenumber end as region_code,
  cast(round(l_extendedprice/l_quantity) as integer) as price_cop,
  cast(round(l_extendedprice*(1+l_tax)/l_quantity) as integer) as list_price_cop,
  l_shipdate as captured_at from lineitem)"""

CUR = """cur as (select store_product_id, region_code, price_cop, list_price_cop, captured_at from (
  select *, row_number() over (partition by store_product_id, region_code
    order by captured_at desc, id desc, price_cop desc, list_price_cop desc) rn from snap) where rn=1)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.min("l_shipdate").cast("timestamp").alias("first_seen_at"), F.max("l_shipdate").cast("timestamp").alias("last_seen_at"))
    )
    measure = (
        F.when(F.col("p_type") == "ECONOMY", "g").when(F.col("p_type") == "LARGE", "kg")
        .when(F.col("p_type") == "MEDIUM", "ml").when(F.col("p_type") == "PROMO", "l")
        .when(F.col("p_type") == "SMALL", "un")
    )
    kind = (
        F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "weight")
        .when(F.col("p_type").isin("MEDIUM", "PROMO"), "volume").otherwise("unit")
    )
    return read(spark, sf_dir, "part").join(seen, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("store_id"),
        F.col("p_partkey").cast("string").alias("external_id"),
        F.concat_ws("|", "p_name", F.col("p_size").cast("string")).alias("ean"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category_id"),
        kind.alias("unit_kind"),
        F.when(measure.isNotNull(), F.col("p_size").cast("decimal(10,3)")).alias("unit_value"),
        measure.alias("unit_measure"),
        (F.col("p_size") <= 45).alias("is_available"),
        "first_seen_at",
        "last_seen_at",
    )


PROD = """prod as (select p_partkey as id, p_brand as store_id, p_name as name, p_brand as brand, p_type as category_id,
  p_name||'|'||p_size as ean, p_size<=45 as is_available,
  case p_type when 'ECONOMY' then 'g' when 'LARGE' then 'kg' when 'MEDIUM' then 'ml' when 'PROMO' then 'l'
    when 'SMALL' then 'un' end as unit_measure,
  case when p_type in ('ECONOMY','LARGE') then 'weight' when p_type in ('MEDIUM','PROMO') then 'volume' else 'unit' end
    as unit_kind,
  case when p_type<>'STANDARD' then p_size end as unit_value, first_seen_at, last_seen_at
  from part left join (select l_partkey, min(l_shipdate) first_seen_at, max(l_shipdate) last_seen_at
    from lineitem group by 1) on l_partkey=p_partkey)"""


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(
        F.min("p_brand").alias("slug"), F.min("p_brand").alias("name"), (F.min("p_retailprice") < 901).alias("is_active")
    )


STORE = """st as (select p_brand as id, min(p_brand) as slug, min(p_brand) as name, min(p_retailprice)<901 as is_active
  from part group by 1)"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("id")).agg(
        F.min("p_type").alias("slug"), F.min("p_type").alias("name"), F.length(F.min("p_type")).alias("sort_order")
    )


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("owner_id"),
        F.col("o_orderpriority").alias("name"),
        (F.col("o_orderstatus") == "F").alias("is_archived"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("list_id"),
        F.col("l_partkey").alias("store_product_id"),
        F.col("l_quantity").cast("decimal(10,3)").alias("quantity"),
        F.col("l_linenumber").alias("position"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("int").alias("price_cop_at_add"),
    )


ITEM = """item as (select l_orderkey as list_id, l_partkey as store_product_id, cast(l_quantity as decimal(10,3)) as quantity,
  l_linenumber as position, cast(round(l_extendedprice/l_quantity) as integer) as price_cop_at_add from lineitem)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("c_nationkey") % 7 + 1).cast("int")
    return read(spark, sf_dir, "customer").withColumn("number", number).select(
        F.col("c_custkey").alias("id"), _region("number").alias("region_code")
    )


PROF = """prof as (select c_custkey as id, case when c_nationkey%7=0 then 'NACIONAL' else 'R'||(c_nationkey%7+1) end
  as region_code from customer)"""

PRICED = """pm as (select i.*, p.region_code, coalesce(a.price_cop, b.price_cop) as today_cop
  from item i join orders o on o.o_orderkey=i.list_id join prof p on p.id=o.o_custkey
  left join cur a on a.store_product_id=i.store_product_id and a.region_code=p.region_code
  left join cur b on b.store_product_id=i.store_product_id and b.region_code='NACIONAL')"""

LT = """lt as (select list_id, p_brand as store_id, count(*) as item_count,
  cast(sum(round(coalesce(today_cop, price_cop_at_add)*quantity)) as bigint) as subtotal_cop,
  cast(sum(round(price_cop_at_add*quantity)) as bigint) as subtotal_at_add_cop
  from pm join part on p_partkey=store_product_id group by 1,2)"""


def with_ctes(body: str, *parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + body
