"""Registered queries: price history, catalogue and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import lists as li
from larder.operators import prices as pr
from larder.operators import views as vw
from larder.plans import views as v
from larder.plans.registry import query
from larder.plans.views import CUR, ITEM, LT, PRICED, PROD, PROF, SNAP, STORE, with_ctes


def _current(spark, sf):
    return pr.latest_price(v.snapshots(spark, sf))


def _day(df, *columns):
    return df.withColumns({c: F.col(c).cast("date") for c in columns})


@query(
    "latest_price",
    with_ctes(
        "select store_product_id, region_code, price_cop, list_price_cop, cast(captured_at as date) captured_at from cur",
        SNAP, CUR,
    ),
)
def latest_price(spark, sf):
    return _day(_current(spark, sf), "captured_at")


@query(
    "resolve_price_fallback",
    with_ctes(
        """select list_id, position, quantity, pm.store_product_id, region_code, today_cop as price_cop from pm""",
        SNAP, CUR, ITEM, PROF, PRICED,
    ),
)
def resolve_price_fallback(spark, sf):
    owner = v.lists(spark, sf).select(F.col("id").alias("list_id"), "owner_id").join(
        v.profiles(spark, sf).withColumnRenamed("id", "owner_id"), "owner_id"
    )
    requests = v.items(spark, sf).join(owner, "list_id").select(
        "list_id", "position", "quantity", "store_product_id", "region_code"
    )
    return pr.resolve_price(requests, _current(spark, sf))


@query(
    "price_for_region",
    with_ctes(
        """select store_product_id, arg_max(price_cop, case when region_code='R3' then 1 else 0 end) as price_cop
        from cur where region_code in ('R3','NACIONAL') group by 1""",
        SNAP, CUR,
    ),
)
def price_for_region(spark, sf):
    return pr.price_for_region(_current(spark, sf), "R3")


@query(
    "diff_prices",
    with_ctes(
        """select p_partkey as store_product_id, 'NACIONAL' as region_code, new_cop as price_cop, old_cop as previous_cop,
        case when old_cop is null then 'new' when old_cop=new_cop then 'same'
          when new_cop>=old_cop*10 or new_cop*10<=old_cop then 'jump' else 'changed' end as decision
        from (select p_partkey, cast(round(p_retailprice) as integer) as new_cop, c.price_cop as old_cop
          from part left join cur c on c.store_product_id=p_partkey and c.region_code='NACIONAL')""",
        SNAP, CUR,
    ),
)
def diff_prices(spark, sf):
    staging = v.read(spark, sf, "part").select(
        F.col("p_partkey").alias("store_product_id"), F.round("p_retailprice").cast("int").alias("price_cop")
    )
    return pr.diff_prices(staging, _current(spark, sf), "NACIONAL").select(
        "store_product_id", "region_code", "price_cop", "previous_cop", "decision"
    )


@query(
    "publish_current",
    with_ctes(
        "select store_product_id, region_code, price_cop, list_price_cop, cast(captured_at as date) captured_at from cur",
        SNAP, CUR,
    ),
)
def publish_current(spark, sf):
    history = v.snapshots(spark, sf)
    split = F.lit("1998-06-01").cast("timestamp")
    old = pr.latest_price(history.where(F.col("captured_at") < split))
    return _day(pr.publish(old, history.where(F.col("captured_at") >= split)), "captured_at")


@query(
    "price_as_of",
    with_ctes(
        """select p.*, s.price_cop, cast(s.captured_at as date) as captured_at from pts p asof left join one s
        on p.store_product_id=s.store_product_id and p.region_code=s.region_code and p.as_of>=s.captured_at""",
        SNAP,
        """one as (select store_product_id, region_code, captured_at, arg_max(price_cop, id*100000000::hugeint+price_cop)
          as price_cop from snap group by 1,2,3)""",
        """pts as (select l_orderkey*8+l_linenumber as point_id, l_partkey as store_product_id,
          case when l_linenumber=1 then 'NACIONAL' else 'R'||l_linenumber end as region_code,
          cast(o_orderdate as date) as as_of from lineitem join orders on o_orderkey=l_orderkey)""",
    ),
)
def price_as_of(spark, sf):
    dates = v.lists(spark, sf).select(F.col("id").alias("l_orderkey"), F.col("updated_at").alias("as_of"))
    points = v.read(spark, sf, "lineitem").join(dates, "l_orderkey").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"),
        F.col("l_partkey").alias("store_product_id"),
        v._region("l_linenumber").alias("region_code"),
        "as_of",
    )
    return _day(pr.price_as_of(v.snapshots(spark, sf), points), "as_of", "captured_at")


@query(
    "price_changes",
    with_ctes(
        """select id, store_product_id, region_code, price_cop, list_price_cop, cast(captured_at as date) as captured_at,
        prev as previous_cop, case when prev<=0 then 0 else price_cop-prev end as delta_cop,
        case when prev is null then null when prev<=0 or prev=price_cop then 'same' when price_cop>prev then 'up'
          else 'down' end as direction,
        case when prev<=0 or prev=price_cop then 0
          else cast(floor(abs(price_cop-prev)::double/prev::double*100+0.5) as bigint) end as percent
        from (select *, lag(price_cop) over (partition by store_product_id, region_code
          order by captured_at, id, price_cop) as prev from snap)""",
        SNAP,
    ),
)
def price_changes(spark, sf):
    return _day(pr.price_changes(v.snapshots(spark, sf)), "captured_at")


@query(
    "unit_price",
    with_ctes(
        """select id, price_cop, unit_value::double as unit_value, unit_measure,
        cast(floor(price_cop/(unit_value*f)*ref+0.5) as bigint) as unit_price_cop,
        case when unit_measure is not null then ref end as per_amount, base as base_measure from (
        select prod.id, c.price_cop, unit_value, unit_measure, case when unit_measure in ('kg','l') then 1000.0 else 1.0 end::double as f,
          case when unit_measure='un' then 1 else 100 end as ref,
          case when unit_measure in ('g','kg') then 'g' when unit_measure in ('ml','l') then 'ml' else unit_measure end as base
        from prod join cur c on c.store_product_id=prod.id and c.region_code='NACIONAL')""",
        SNAP, CUR, PROD,
    ),
)
def unit_price(spark, sf):
    national = _current(spark, sf).where("region_code = 'NACIONAL'").select(
        F.col("store_product_id").alias("id"), "price_cop"
    )
    priced = v.products(spark, sf).select("id", "unit_value", "unit_measure").join(national, "id")
    return pr.unit_price(priced).withColumn("unit_value", F.col("unit_value").cast("double"))


@query(
    "compact_history",
    with_ctes(
        """select distinct id, store_product_id, region_code, price_cop, list_price_cop, cast(captured_at as date) captured_at
        from (select *, row_number() over (partition by store_product_id, region_code, date_trunc('month', captured_at)
            order by captured_at, id, price_cop, list_price_cop) up,
          row_number() over (partition by store_product_id, region_code, date_trunc('month', captured_at)
            order by captured_at desc, id desc, price_cop desc, list_price_cop desc) dn from snap)
        where up=1 or dn=1 or cast(captured_at as date) > date '2000-06-30' - 90""",
        SNAP,
    ),
)
def compact_history(spark, sf):
    return _day(pr.compact_history(v.snapshots(spark, sf).distinct(), F.lit("2000-06-30").cast("date")), "captured_at")


@query(
    "storage_estimate",
    with_ctes(
        """select 'catalogue' as part, store_id, strftime(first_seen_at,'%Y-%m') as month, count(*) as rows,
        cast(sum(8 + strlen(store_id)+strlen(id::varchar)+strlen(ean)+strlen(name)+strlen(brand)+strlen(category_id)
          +strlen(unit_kind)+8+coalesce(strlen(unit_measure),0)+8+8+8) as bigint) as bytes from prod group by 2,3
        union all
        select 'history', store_id, strftime(captured_at,'%Y-%m'), count(*), cast(sum(strlen(region_code)+32) as bigint)
        from snap join prod on prod.id=store_product_id group by 2,3""",
        SNAP, PROD,
    ),
)
def storage_estimate(spark, sf):
    return pr.storage_estimate(v.snapshots(spark, sf), v.products(spark, sf))


PRICE_R3 = """pr3 as (select store_product_id, arg_max(price_cop, case when region_code='R3' then 1 else 0 end) as price_cop
  from cur where region_code in ('R3','NACIONAL') group by 1)"""
SHOWN = """shown as (select prod.*, pr3.price_cop from prod join pr3 on pr3.store_product_id=prod.id where is_available)"""


@query(
    "catalog_products",
    with_ctes(
        """select prod.id, st.slug as store_slug, category_id as category_slug, prod.name, brand, is_available, price_cop
        from prod join pr3 on store_product_id=prod.id join st on st.id=store_id""",
        SNAP, CUR, PROD, STORE, PRICE_R3,
    ),
)
def catalog_products(spark, sf):
    return _catalog(spark, sf).select(
        "id", "store_slug", "category_slug", "name", "brand", "is_available", "price_cop"
    )


def _catalog(spark, sf):
    return vw.catalog_products(
        v.products(spark, sf), v.stores(spark, sf), v.categories(spark, sf), _current(spark, sf), "R3"
    )


@query(
    "products_by_ids",
    with_ctes(
        """select prod.id, name, price_cop from prod join pr3 on store_product_id=prod.id
        where prod.id in (select l_partkey from lineitem where l_returnflag='R')""",
        SNAP, CUR, PROD, PRICE_R3,
    ),
)
def products_by_ids(spark, sf):
    ids = v.read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return vw.products_by_ids(_catalog(spark, sf), ids).select("id", "name", "price_cop")


SUMMARY = """sm as (select st.id, st.is_active, count(shown.id) as product_count, max(last_seen_at) as last_updated_at
  from st left join shown on shown.store_id=st.id group by 1,2)"""


@query(
    "store_summary",
    with_ctes(
        "select id, is_active, product_count, cast(last_updated_at as date) as last_updated_at from sm",
        SNAP, CUR, PROD, STORE, PRICE_R3, SHOWN, SUMMARY,
    ),
)
def store_summary(spark, sf):
    return _day(_summary(spark, sf), "last_updated_at").drop("slug", "name")


def _summary(spark, sf):
    return vw.store_summary(v.stores(spark, sf), v.products(spark, sf), _current(spark, sf), "R3")


@query(
    "store_category_summary",
    with_ctes(
        """select store_id, category_id, store_id as store_slug, category_id as category_slug, category_id as category_name,
        length(category_id) as sort_order, count(*) as product_count from shown group by 1,2""",
        SNAP, CUR, PROD, PRICE_R3, SHOWN,
    ),
)
def store_category_summary(spark, sf):
    return vw.store_category_summary(
        v.stores(spark, sf), v.categories(spark, sf), v.products(spark, sf), _current(spark, sf), "R3"
    )


@query(
    "counts_match_listing",
    with_ctes(
        "select id, product_count as counted, product_count as listed, 0 as mismatch from sm",
        SNAP, CUR, PROD, STORE, PRICE_R3, SHOWN, SUMMARY,
    ),
)
def counts_match_listing(spark, sf):
    return vw.counts_match_listing(_summary(spark, sf), _catalog(spark, sf))


@query(
    "store_freshness",
    with_ctes(
        """select id, product_count, h as hours_old, h//24 as days_old,
        case when h is null then 'Sin datos todavía' when h<1 then 'Precios de hace un momento'
          when h<24 then 'Precios de hace '||h||' h' when h//24=1 then 'Precios de ayer'
          else 'Precios de hace '||(h//24)||' días' end as freshness, is_active and product_count>0 as browsable
        from (select *, cast(floor((epoch(timestamp '2001-12-01 09:30:00')-epoch(last_updated_at))/3600) as bigint) as h
          from sm)""",
        SNAP, CUR, PROD, STORE, PRICE_R3, SHOWN, SUMMARY,
    ),
)
def store_freshness(spark, sf):
    fresh = vw.with_freshness(_summary(spark, sf), F.lit("2001-12-01 09:30:00"))
    return fresh.select("id", "product_count", "hours_old", "days_old", "freshness", "browsable")


# One search per distinct (first word of a document's line of stock, region): derived from part and customer.
REQ = """req as (select row_number() over (order by q, region_code, store_slug, category_slug, page_offset) as request_id, * from (
  select distinct left(p_name, 1 + p_size // 10) as q, 'R'||(1 + p_size // 8) as region_code,
    case when p_size>40 then p_brand end as store_slug, case when p_size between 30 and 35 then p_type end as category_slug,
    case when p_size<20 then 0 else 20 end as page_offset from part
  union all select distinct '', 'R3', p_brand, null, 0 from part
  union all select distinct '  ', 'R4', null, p_type, 20 from part))"""


def _requests(spark, sf):
    part = v.read(spark, sf, "part")
    size = F.col("p_size")
    words = part.select(
        F.expr("left(p_name, 1 + int(p_size / 10))").alias("query"),
        F.concat(F.lit("R"), (1 + F.floor(size / 8)).cast("string")).alias("region_code"),
        F.when(size > 40, F.col("p_brand")).alias("store_slug"),
        F.when(size.between(30, 35), F.col("p_type")).alias("category_slug"),
        F.when(size < 20, 0).otherwise(20).alias("page_offset"),
    ).distinct()
    by_store = part.select(
        F.lit("").alias("query"), F.lit("R3").alias("region_code"), F.col("p_brand").alias("store_slug"),
        F.lit(None).cast("string").alias("category_slug"), F.lit(0).alias("page_offset"),
    ).distinct()
    by_aisle = part.select(
        F.lit("  ").alias("query"), F.lit("R4").alias("region_code"), F.lit(None).cast("string").alias("store_slug"),
        F.col("p_type").alias("category_slug"), F.lit(20).alias("page_offset"),
    ).distinct()
    key = F.concat_ws("|", "query", "region_code", F.coalesce("store_slug", F.lit("-")), F.coalesce("category_slug", F.lit("-")), F.col("page_offset").cast("string"))
    return words.unionByName(by_store).unionByName(by_aisle).withColumn("request_id", key)


@query(
    "search_prefix",
    with_ctes(
        """select request_id, rank, id, name, price_cop from (
        select r.request_id, page_offset, row_number() over (partition by r.request_id order by p.name, p.id) as rank, p.id,
          p.name, coalesce(a.price_cop, b.price_cop) as price_cop
        from req r join tok p on len(list_filter(r.terms, lambda t: len(list_filter(p.tokens, lambda k: starts_with(k, t)))=0))=0
          and (r.store_slug is null or r.store_slug=p.store_id) and (r.category_slug is null or r.category_slug=p.category_id)
        left join cur a on a.store_product_id=p.id and a.region_code=r.region_code
        left join cur b on b.store_product_id=p.id and b.region_code='NACIONAL'
        where coalesce(a.price_cop, b.price_cop) is not null) where rank>page_offset and rank<=page_offset+20""",
        SNAP, CUR, PROD,
        """tok as (select prod.*, string_split_regex(lower(name||' '||brand), '[^a-z0-9]+') as tokens from prod where is_available)""",
        REQ.replace("row_number() over (order by q, region_code, store_slug, category_slug, page_offset) as request_id, *",
            """concat_ws('|', q, region_code, coalesce(store_slug,'-'), coalesce(category_slug,'-'), page_offset::varchar) as request_id, *,
            list_filter(string_split_regex(lower(q), '[^a-z0-9]+'), lambda t: t<>'') as terms"""),
    ),
)
def search_prefix(spark, sf):
    return vw.search_products(
        _requests(spark, sf), v.products(spark, sf), v.stores(spark, sf), v.categories(spark, sf), _current(spark, sf)
    )


@query(
    "equivalents_by_key",
    with_ctes(
        """select ean, count(distinct store_id) as stores, min(price_cop) as min_cop, max(price_cop) as max_cop,
        max(price_cop)-min(price_cop) as gap_cop, arg_min(store_id, k) as cheapest_store_id, arg_min(id, k) as cheapest_id
        from (select prod.*, price_cop, row_number() over (order by price_cop, store_id, prod.id) as k
          from prod join pr3 on store_product_id=prod.id) group by ean having count(distinct store_id)>=2""",
        SNAP, CUR, PROD, PRICE_R3,
    ),
)
def equivalents_by_key(spark, sf):
    return vw.equivalents_by_ean(_catalog(spark, sf))


@query(
    "equivalents_fuzzy",
    with_ctes(
        """select gid as group_a, gid as group_b, text as text_a, text as text_b, members as members_a, members as members_b,
          1.0::double as jaccard, barcodes, stores from g where members>1 and (barcodes<>1 or coded<members)
        union all select a.gid as group_a, b.gid as group_b, a.text as text_a, b.text as text_b, a.members as members_a,
        b.members as members_b, i::double/(len(a.sh)+len(b.sh)-i)::double as jaccard, null, null from sh a join sh b on a.block=b.block and a.gid<b.gid,
        lateral (select len(list_intersect(a.sh, b.sh)) as i)
        where i::double/(len(a.sh)+len(b.sh)-i)>=0.6-1e-9 and not coalesce(a.ean=b.ean, false)""",
        PROD,
        """g as (select block, text, min(id) as gid, count(*) as members,
          case when min(ean)=max(ean) then min(ean) end as ean, count(distinct ean) as barcodes, count(distinct store_id) as stores,
          count(ean) as coded from (
          select *, unit_kind||'|'||category_id as block, trim(regexp_replace(lower(name||' '||brand), '[^a-z0-9]+', ' ', 'g')) as text
          from prod) group by 1,2)""",
        """sh as (select *, list_distinct(list_transform(range(1, length(text)-1), lambda x: substr(text, x::int, 3))) as sh from g)""",
    ),
)
def equivalents_fuzzy(spark, sf):
    products = v.products(spark, sf).withColumn("base_amount", F.col("category_id"))
    return vw.equivalents_fuzzy(products, 0.6)


@query(
    "list_totals",
    with_ctes("select * from lt", SNAP, CUR, ITEM, PROF, PRICED, LT),
)
def list_totals(spark, sf):
    return li.list_totals(
        v.items(spark, sf), v.lists(spark, sf), v.profiles(spark, sf), v.products(spark, sf), _current(spark, sf)
    )


@query(
    "list_summary",
    with_ctes(
        """select o_orderkey as id, o_orderpriority as name, cast(coalesce(sum(item_count),0) as bigint) as item_count,
        count(store_id) as store_count, cast(coalesce(sum(subtotal_cop),0) as bigint) as total_cop,
        cast(coalesce(sum(subtotal_at_add_cop),0) as bigint) as total_at_add_cop
        from orders left join lt on list_id=o_orderkey where o_orderstatus<>'F' group by 1,2""",
        SNAP, CUR, ITEM, PROF, PRICED, LT,
    ),
)
def list_summary(spark, sf):
    return li.list_summary(v.lists(spark, sf), list_totals(spark, sf)).drop("owner_id", "is_archived", "updated_at")


@query(
    "draft_rollup",
    with_ctes(
        """select list_id as draft_id, p_brand as store_slug, p_brand as store_name, count(*) as item_count,
        sum(price_cop_at_add*quantity)::double as subtotal_cop, false as is_total from item
        join part on p_partkey=store_product_id group by 1,2
        union all select list_id, null, null, count(*), sum(price_cop_at_add*quantity)::double, true from item
        join part on p_partkey=store_product_id group by 1""",
        ITEM,
    ),
)
def draft_rollup(spark, sf):
    brand = v.read(spark, sf, "part").select(
        F.col("p_partkey").alias("store_product_id"), F.col("p_brand").alias("store_slug"), F.col("p_brand").alias("store_name")
    )
    draft = v.items(spark, sf).join(brand, "store_product_id").withColumnsRenamed(
        {"list_id": "draft_id", "price_cop_at_add": "price_cop"}
    )
    return li.draft_totals(draft).withColumn("subtotal_cop", F.col("subtotal_cop").cast("double"))


@query(
    "item_drift",
    with_ctes(
        """select list_id, store_product_id, quantity::double as quantity, price_cop_at_add, today_cop,
        today_cop-price_cop_at_add as delta_cop,
        case when today_cop is null then null when today_cop=price_cop_at_add then 'same'
          when today_cop>price_cop_at_add then 'up' else 'down' end as direction,
        cast(floor(abs(today_cop-price_cop_at_add)::double/price_cop_at_add::double*100+0.5) as bigint) as percent,
        today_cop is null as no_price_today from pm""",
        SNAP, CUR, ITEM, PROF, PRICED,
    ),
)
def item_drift(spark, sf):
    drift = li.item_drift(v.items(spark, sf), v.lists(spark, sf), v.profiles(spark, sf), _current(spark, sf))
    return drift.withColumn("quantity", F.col("quantity").cast("double"))


@query(
    "merge_draft",
    """with d as (select l_orderkey as draft_id, l_partkey as store_product_id, l_quantity as quantity from lineitem
         where l_returnflag='N'),
       k as (select l_orderkey as draft_id, l_partkey as store_product_id, l_quantity as quantity from lineitem
         where l_returnflag<>'N')
       select * from d union all select * from k where not exists (
         select 1 from d where d.draft_id=k.draft_id and d.store_product_id=k.store_product_id)""",
)
def merge_draft(spark, sf):
    rows = v.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("draft_id"), F.col("l_partkey").alias("store_product_id"),
        F.col("l_quantity").alias("quantity"), "l_returnflag",
    )
    return li.merge_draft(rows.where("l_returnflag = 'N'"), rows.where("l_returnflag <> 'N'"))


def _saves(spark, sf):
    """Every order is a save of its customer's one list; the payload is the order's lines as JSON."""
    entry = F.struct(
        "l_linenumber", "l_quantity", F.col("l_partkey").cast("string").alias("p"),
    )
    lines = v.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    payload = F.to_json(
        F.transform("e", lambda x: F.struct(x["p"].alias("store_product_id"), x["l_quantity"].alias("quantity")))
    )
    orders = v.read(spark, sf, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_orderkey").alias("save_id"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("owner_id"),
        F.col("o_custkey").alias("list_id"), F.lit(True).alias("is_new"), F.col("o_orderpriority").alias("name"),
        F.coalesce(payload, F.lit("[]")).alias("items"),
    )


PARSED = """parsed as (select l_orderkey as save_id, cast(l_partkey as varchar) as store_product_id,
  arg_max(l_quantity, pos) as quantity, max(pos) as position
  from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, cast(l_partkey as varchar))-1
  as pos from lineitem) group by 1,2)"""


@query("parse_list_items", with_ctes("select save_id, store_product_id, quantity, position from parsed", PARSED))
def parse_list_items(spark, sf):
    return li.parse_list_items(_saves(spark, sf)).withColumn("quantity", F.col("quantity").cast("double"))


SAVED = [
    SNAP, CUR, PROF, PARSED,
    """lines as (select p.*, o_custkey as list_id, coalesce(a.price_cop, b.price_cop) as today from parsed p
      join orders on o_orderkey=save_id left join prof on prof.id=o_custkey
      left join cur a on a.store_product_id=p.store_product_id::bigint and a.region_code=coalesce(prof.region_code,'NACIONAL')
      left join cur b on b.store_product_id=p.store_product_id::bigint and b.region_code='NACIONAL')""",
    """verdict as (select o_orderkey as save_id, o_custkey as list_id, case when n is null then '22023'
      when missing>0 then 'P0001' end as error from orders left join (select save_id, count(*) n,
      count(*) filter (where today is null) missing from lines group by 1) on save_id=o_orderkey)""",
]


def _applied(spark, sf):
    current = _current(spark, sf).withColumn("store_product_id", F.col("store_product_id").cast("string"))
    none_yet = v.lists(spark, sf).where("false").select("id", "owner_id", "name", "is_archived")
    no_items = spark.createDataFrame(
        [], "list_id bigint, store_product_id string, quantity decimal(10,3), position int, price_cop_at_add int"
    )
    return li.apply_list_saves(_saves(spark, sf), none_yet, no_items, v.profiles(spark, sf), current)


@query("list_save_verdicts", with_ctes("select save_id, list_id, error from verdict", *SAVED))
def list_save_verdicts(spark, sf):
    return _applied(spark, sf)[0].select("save_id", "list_id", "error")


@query(
    "list_saves",
    with_ctes(
        """select l.list_id, store_product_id, quantity, position, today as price_cop_at_add from lines l
        join (select list_id, max(save_id) as save_id from verdict where error is null group by 1) k on k.save_id=l.save_id""",
        *SAVED,
    ),
)
def list_saves(spark, sf):
    return _applied(spark, sf)[1].withColumn("quantity", F.col("quantity").cast("double"))


@query(
    "owned_items",
    """select l_orderkey as list_id, l_partkey as store_product_id, l_linenumber as position from lineitem
       where l_orderkey in (select o_orderkey from orders where o_custkey in
         (select c_custkey from customer where c_mktsegment='BUILDING'))""",
)
def owned_items(spark, sf):
    owners = v.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner_id"))
    lists = v.lists(spark, sf)
    _, own, _ = li.owned_by(owners, lists, v.items(spark, sf), lists.select("id", "owner_id"))
    return own.select("list_id", "store_product_id", "position")


RESAVED = [
    SNAP, CUR, PROF, PARSED,
    """lst as (select o_orderkey as list_id, o_custkey, o_orderstatus='F' as archived, o_custkey+case when o_orderkey%10=0 then 1000000 else 0 end as owner
      from orders)""",
    """e as (select l.list_id, p.store_product_id, p.quantity, p.store_product_id::bigint%3<>0 as in_first, case when p.store_product_id::bigint%2=0
        then 1+p.store_product_id::bigint%100 end as held, coalesce(a.price_cop, b.price_cop) as today
      from parsed p join lst l on l.list_id=p.save_id left join prof on prof.id=l.owner
      left join cur a on a.store_product_id=p.store_product_id::bigint and a.region_code=coalesce(prof.region_code,'NACIONAL')
      left join cur b on b.store_product_id=p.store_product_id::bigint and b.region_code='NACIONAL')""",
    """v1 as (select l.list_id, case when coalesce(n,0)=0 then '22023' when archived or owner<>o_custkey then 'P0002' when missing>0 then 'P0001' end as error
      from lst l left join (select list_id, count(*) as n, count(*) filter (where today is null and held is null) as missing from e where in_first group by 1) x
      on x.list_id=l.list_id)""",
    """v2 as (select l.list_id, case when n is null then '22023' when l.list_id%14=0 then '23514' when archived or owner<>o_custkey then 'P0002'
        when missing>0 then 'P0001' end as error
      from lst l left join (select e.list_id, count(*) as n, count(*) filter (where today is null and (held is null or (v1.error is null and not in_first))) as missing
        from e join v1 on v1.list_id=e.list_id group by 1) x on x.list_id=l.list_id)""",
]


def _resaved(spark, sf):
    """Lists that hold some products at old prices are saved twice: without every third product, then with all again.

    Some lists are archived, some saves are another owner's, some second names are blank.
    """
    orders = v.read(spark, sf, "orders")
    key = F.col("o_orderkey")
    lists = orders.select(key.alias("id"), F.col("o_custkey").alias("owner_id"), F.lit("old").alias("name"), (F.col("o_orderstatus") == "F").alias("is_archived"))
    lines = v.read(spark, sf, "lineitem")
    held = lines.where("l_partkey % 2 = 0").join(orders, F.col("l_orderkey") == key).select(
        F.col("l_orderkey").alias("list_id"), F.col("l_partkey").cast("string").alias("store_product_id")).distinct()
    held = held.select("*", F.lit(1).cast("decimal(10,3)").alias("quantity"), F.lit(0).alias("position"),
                       (1 + F.col("store_product_id").cast("bigint") % 100).cast("int").alias("price_cop_at_add"))
    entry = F.struct("l_linenumber", "l_quantity", F.col("l_partkey").cast("string").alias("p"))
    packed = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    shaped = lambda e: F.to_json(F.transform(e, lambda x: F.struct(x["p"].alias("store_product_id"), x["l_quantity"].alias("quantity"))))
    rows = orders.join(packed, key == F.col("l_orderkey"), "left")
    owner = F.col("o_custkey") + F.when(key % 10 == 0, 1_000_000).otherwise(0)

    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("number"))
    again = F.col("number") == 1
    part = F.when(again, F.col("e")).otherwise(F.filter("e", lambda x: x["p"].cast("bigint") % 3 != 0))
    saves = rows.select((key * 2 + F.col("number")).alias("save_id"), F.col("number").cast("bigint").alias("seq"), owner.alias("owner_id"), key.alias("list_id"),
                        F.lit(False).alias("is_new"), F.when(again & (key % 14 == 0), "  ").otherwise("again").alias("name"),
                        F.coalesce(shaped(part), F.lit("[]")).alias("items"))
    current = _current(spark, sf).withColumn("store_product_id", F.col("store_product_id").cast("string"))
    return li.apply_list_saves(saves, lists, held, v.profiles(spark, sf), current)


@query(
    "list_resave_verdicts",
    with_ctes("select list_id*2 as save_id, error from v1 union all select list_id*2+1, error from v2", *RESAVED),
)
def list_resave_verdicts(spark, sf):
    return _resaved(spark, sf)[0].select("save_id", "error")


@query(
    "list_resaves",
    with_ctes(
        """select e.list_id, store_product_id, case when v2.error is null or v1.error is null then quantity else 1 end as quantity,
          case when v2.error is not null and v1.error is not null then held when v2.error is null and v1.error is null and not in_first then today
            else coalesce(held, today) end as price_cop_at_add
        from e join v1 on v1.list_id=e.list_id join v2 on v2.list_id=e.list_id
        where case when v2.error is null then true when v1.error is null then in_first else held is not null end""",
        *RESAVED,
    ),
)
def list_resaves(spark, sf):
    return _resaved(spark, sf)[1].select("list_id", "store_product_id", F.col("quantity").cast("double").alias("quantity"), "price_cop_at_add")
