"""Registered queries: proximity, shops, addresses, reminders, trips, streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from larder.operators import branches as br
from larder.operators import geocode as gc
from larder.operators import prices as pr
from larder.operators import proximity as px
from larder.operators import reminders as rm
from larder.operators import trips as tr
from larder.plans import views as v
from larder.plans.registry import query
from larder.session import cut_lineage, shared_folder
from larder.plans.views import CUR, ITEM, LT, PRICED, PROF, SNAP, with_ctes
from larder.sources.versions import buckets_for
from larder.streaming import jobs

# --- proximity ----------------------------------------------------------------------------------------------------
# Shops stand where the embeddings' first two values put them in the country's box; origins where customers' balances do.

SHOPS = """shop as (select vec_id as id, label as store_id, 4.5::double + 4*embedding[1]::double as latitude,
  -74.0::double + 4*embedding[2]::double as longitude, embedding[3]>-0.3 as is_active from embeddings)"""
ORIGINS = """origin as (select c_custkey as origin_id, 4.5::double + c_acctbal/5000-0.9 as lat, -74.9::double + c_nationkey*0.07::double as lng from customer)"""
SNAPPED = """snapped as (select origin_id, round(floor(lat/0.001+0.5)*0.001,3) as lat, round(floor(lng/0.001+0.5)*0.001,3) as lng from origin)"""
METRES = """2*6371000.0*asin(sqrt(least(1.0, sin(radians(latitude-lat)/2)*sin(radians(latitude-lat)/2)
  +cos(radians(lat))*cos(radians(latitude))*sin(radians(longitude-lng)/2)*sin(radians(longitude-lng)/2))))"""


def _shops(spark, sf):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return v.read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("store_id"), (4.5 + 4 * at(0)).alias("latitude"),
        (-74.0 + 4 * at(1)).alias("longitude"), (F.get("embedding", F.lit(2)) > -0.3).alias("is_active"),
    )


def _origins(spark, sf):
    return v.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("origin_id"), (4.5 + F.col("c_acctbal") / 5000 - 0.9).alias("lat"),
        (-74.9 + F.col("c_nationkey") * 0.07).alias("lng"),
    )


@query("snap_origins", with_ctes("select * from snapped", ORIGINS, SNAPPED))
def snap_origins(spark, sf):
    return px.snap_origins(_origins(spark, sf))


@query(
    "nearest_points",
    with_ctes(
        f"""select origin_id, id, store_id, rank, cast(round(m) as bigint) as distance_m from (
        select *, row_number() over (partition by origin_id order by m, id) as rank from (
        select origin_id, id, store_id, {METRES} as m from snapped, shop where is_active) where m<=25000) where rank<=30""",
        SHOPS, ORIGINS, SNAPPED,
    ),
)
def nearest_points(spark, sf):
    near = px.nearest_branches(px.snap_origins(_origins(spark, sf)), _shops(spark, sf))
    return near.select("origin_id", "id", "store_id", "rank", "distance_m")


CHAINS = """chain as (select label as id, 'chain '||label as name, label<>3 as is_active,
  count(*) filter (embedding[4]>0.1) as product_count from embeddings group by 1)"""


@query(
    "stores_near",
    with_ctes(
        f"""select origin_id, store_id, name, product_count, browsable, cast(round(m) as bigint) as nearest_m,
        row_number() over (partition by origin_id order by browsable desc, m, name) as rank from (
        select origin_id, store_id, name, product_count, is_active and product_count>0 as browsable, min(m) as m from (
          select origin_id, store_id, {METRES} as m from snapped, shop where is_active) join chain on chain.id=store_id
        where m<=25000 group by all)""",
        SHOPS, ORIGINS, SNAPPED, CHAINS,
    ),
)
def stores_near(spark, sf):
    summary = v.read(spark, sf, "embeddings").groupBy(F.col("label").alias("id")).agg(
        F.count_if(F.get("embedding", F.lit(3)) > 0.1).alias("product_count")
    ).withColumns({"name": F.concat(F.lit("chain "), F.col("id").cast("string")), "is_active": F.col("id") != 3})
    near = px.stores_near(px.snap_origins(_origins(spark, sf)), _shops(spark, sf), summary)
    return near.select("origin_id", "store_id", "name", "product_count", "browsable", "nearest_m", "rank")


@query(
    "add_distances",
    f"""select o_orderkey, cast(round(m) as bigint) as distance_m, case when m<100 then 'menos de 100 m'
         when s100<1000 then s100::bigint||' m' when s100/1000.0<10 then replace(printf('%.1f', s100/1000.0),'.',',')||' km'
         else cast(floor(s100/1000.0+0.5) as bigint)||' km' end as list_label,
       case when s10<1000 then s10::bigint||' m' when m/1000<10 then replace(printf('%.1f', m/1000),'.',',')||' km'
         else cast(floor(m/1000+0.5) as bigint)||' km' end as map_label, case when m<1500 then 'foot' else 'car' end as mode,
       case when mi<60 then mi||' min' when mi%60=0 then mi//60||' h' else mi//60||' h '||mi%60||' min' end as duration_label
       from (select *, floor(m/100+0.5)*100 as s100, greatest(10, floor(m/10+0.5)*10) as s10,
         greatest(1, cast(floor(o_totalprice/60+0.5) as bigint)) as mi from (
       select o_orderkey, o_totalprice, {METRES} as m from (select o_orderkey, o_totalprice, 4.5::double as lat, -74.0::double as lng,
         4.5::double+c_acctbal/100000 as latitude, -74.0::double+o_totalprice/10000000 as longitude from orders join customer on c_custkey=o_custkey)))""",
)
def add_distances(spark, sf):
    pairs = v.read(spark, sf, "orders").join(v.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.lit(4.5).alias("lat"), F.lit(-74.0).alias("lng"), (4.5 + F.col("c_acctbal") / 100000).alias("latitude"),
        (-74.0 + F.col("o_totalprice") / 10000000).alias("longitude"), F.col("o_totalprice").alias("seconds"),
    )
    out = px.add_distances(pairs, "seconds").withColumn("distance_m", F.round("distance_m").cast("bigint"))
    return out.select("o_orderkey", "distance_m", "list_label", "map_label", "mode", "duration_label")


# --- shops --------------------------------------------------------------------------------------------------------


@query(
    "saturated_points",
    """select l_returnflag as store, l_suppkey::varchar as point, l_orderkey from lineitem where l_linenumber=1 and l_extendedprice>=50000""",
)
def saturated_points(spark, sf):
    log = v.read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("store"), F.struct(F.col("l_suppkey").cast("string").alias("point"), "l_orderkey").alias("point"),
        F.col("l_linenumber").alias("page_no"), (F.col("l_extendedprice") * 0.006).alias("total"),
    )
    return br.saturated_points(log).select("store", "point.point", "point.l_orderkey")


@query(
    "normalize_pickup_points",
    """select c_custkey, status, case when status='ok' then c_custkey::varchar end as external_id,
       case when status='ok' then 'Jumbo '||upper(left(c_mktsegment,1))||lower(substr(c_mktsegment,2)) end as name,
       case when status='ok' then 'Nation '||c_nationkey end as city from (select *, case when c_acctbal<-500 then 'failed'
         when c_mktsegment='HOUSEHOLD' then 'skipped' when c_acctbal>9000 then 'skipped' when c_nationkey=20 then 'skipped' else 'ok' end as status from customer)""",
)
def normalize_pickup_points(spark, sf):
    customer = v.read(spark, sf, "customer")
    key, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    place = F.when(F.col("c_acctbal") >= -500, F.array(F.when(F.col("c_nationkey") == 20, 2.3).otherwise(-74.0), F.lit(4.6)))
    point = F.struct(
        F.concat(F.lit("jumbo_00"), key).alias("id"),
        F.when(segment == "HOUSEHOLD", "JM Donación").otherwise(F.concat(F.lit("JM  "), segment)).alias("friendlyName"),
        (F.col("c_acctbal") <= 9000).alias("isActive"),
        F.struct(
            F.lit(" ").alias("street"), F.concat(F.lit("Provincia de NATION "), F.col("c_nationkey").cast("string"), F.lit(", D.C.")).alias("city"),
            place.alias("geoCoordinates"),
        ).alias("address"),
    )
    rows = br.jumbo_branches(customer.select(F.lit("jumbo").alias("store"), F.col("c_custkey").alias("pos"), point.alias("raw")))
    return rows.select(F.col("pos").alias("c_custkey"), "status", "external_id", "name", "city")


@query(
    "collect_branches",
    """select user_id as store, min(event_id) as pos, event_type as external_id from events group by 1,3""",
)
def collect_branches(spark, sf):
    staged = v.read(spark, sf, "events").select(
        F.col("user_id").alias("store"), F.col("event_id").alias("pos"), F.col("event_type").alias("external_id"), F.lit("ok").alias("status")
    )
    return br.collect_branches(staged).drop("status")


# --- addresses ----------------------------------------------------------------------------------------------------


def _addresses(spark, sf):
    """Every line item writes an address: 'Cra 80 A # 50-87 Sur' and relatives."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    line = v.read_spread(spark, sf, "lineitem", *columns)
    word = (
        F.when(F.col("l_returnflag") == "A", "CRA ").when(F.col("l_returnflag") == "N", "Calle ").otherwise("Av. Carrera ")
    )
    tail = F.when(F.col("l_linestatus") == "O", " SUR").otherwise(" Barrio Centro")
    text = F.concat(
        word, F.col("l_partkey").cast("string"), F.lit(" No. "), F.col("l_suppkey").cast("string"), F.lit("B – "),
        F.col("l_quantity").cast("int").cast("string"), tail,
    )
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("address"))


@query(
    "parse_addresses",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when l_returnflag='N' then 'Calle ' else 'Carrera ' end||l_partkey||case when l_returnflag='N' and l_linestatus='O' then ' Sur' else '' end as street,
       case when l_returnflag='N' then 'Carrera ' else 'Calle ' end||l_suppkey||'B'||case when l_returnflag<>'N' and l_linestatus='O' then ' Sur' else '' end as cross_street,
       cast(l_quantity as integer)::varchar as plate from lineitem""",
)
def parse_addresses(spark, sf):
    parsed = gc.parse_addresses(_addresses(spark, sf))
    return parsed.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", gc.street_label(F.col("street")).alias("street"),
        gc.street_label(F.col("cross")).alias("cross_street"), "plate",
    )


def _targets(spark, sf):
    part = v.read_spread(spark, sf, "part", "p_partkey", "p_name", "p_size", "p_type")
    town = F.when(F.col("p_type") == "PROMO", "ANTIOQUIA").when(F.col("p_type") == "SMALL", "MEDELLÍN").otherwise("Bogotá D.C.")
    state = F.when(F.col("p_type") == "PROMO", "Medellín").when(F.col("p_type") == "SMALL", "ANTIOQUIA")
    address = F.when(F.col("p_type") == "LARGE", "Mall sin calle").otherwise(
        F.concat(F.lit("<p>Cra "), F.col("p_size").cast("string"), F.lit(" # 50-"), F.col("p_partkey").cast("string"), F.lit("</p>"))
    )
    # parsed once and read several times: a cut keeps later filters from copying the parsing expressions
    return cut_lineage(gc.geocode_questions(gc.shop_targets(part.select(
        F.col("p_partkey").alias("shop_id"), F.col("p_name").alias("title"), address.alias("content"), town.alias("municipality"), state.alias("department")))))


@query(
    "geocode_requests",
    """with t as (select p_size, p_partkey, case when p_type in ('PROMO','SMALL') then 'Medellin, Antioquia' else 'Bogota D.C.' end as town
         from part where p_type<>'LARGE')
       select 'Carrera '||p_size||' 50-'||p_partkey||', '||town as query from t where p_size<40 union select 'Calle 50, '||town from t""",
)
def geocode_requests(spark, sf):
    targets = _targets(spark, sf)
    landed = targets.where(F.split_part("address_query", F.lit(" "), F.lit(2)).cast("int") >= 40).select(
        F.col("address_query").alias("query"), F.lit("2026-09-01").cast("timestamp").alias("fetched_at")
    )
    return gc.geocode_requests(targets, landed, F.lit("2026-10-01").cast("timestamp"))


@query(
    "resolve_locations",
    """with t as (select p_partkey, p_size, p_type from part)
       select p_partkey as shop_id, case when p_type='LARGE' then 'address without a street' when p_size<10 then 'no result'
         when p_size<20 then 'another municipality' when p_size<30 then 'address' when p_size<40 then 'intersection' else 'street' end as outcome
       from t""",
)
def resolve_locations(spark, sf):
    return _resolved(spark, sf).select("shop_id", F.coalesce("target_problem", "geocode_problem", "precision").alias("outcome"))


@query(
    "location_tally",
    """select case when p_type='LARGE' then 'address without a street' when p_size<10 then 'no result' when p_size<20 then 'another municipality'
         when p_size<30 then 'address' when p_size<40 then 'intersection' else 'street' end as outcome, count(*) as shops from part group by 1""",
)
def location_tally(spark, sf):
    return gc.outcome_tally(_resolved(spark, sf))


def _resolved(spark, sf):
    """Each product's address gets the answer its size calls for: none, elsewhere, a door, a corner, a short street."""
    targets = _targets(spark, sf)
    size = F.split_part("address_query", F.lit(" "), F.lit(2)).cast("int")
    medellin = F.contains("address_query", F.lit("Medellin"))
    town, state = F.when(medellin, "Medellín").otherwise("Bogotá"), F.when(medellin, "Antioquia").otherwise("Bogotá, D.C.")
    plate = F.regexp_extract("address_query", r"(50-[0-9]+)", 1)

    def hit(road, rank, category, house, city, south, west, tall=0.001, wide=0.001):
        address = F.map_from_arrays(
            F.array(*[F.lit(k) for k in ("road", "house_number", "city", "state")]), F.array(road, house, city, state)
        )
        text = F.lit(None).cast("string")
        return F.struct(
            F.lit(south).alias("lat"), F.lit(west).alias("lon"), F.lit(rank).alias("place_rank"), F.lit(category).alias("category"),
            text.alias("type"), F.when(F.lit(category == "highway"), road).alias("name"), address.alias("address"),
            F.array(*[F.lit(x) for x in (south, south + tall, west, west + wide)]).alias("boundingbox"),
        )

    own = F.concat(F.lit("Carrera "), size.cast("string"))
    nothing = F.lit(None).cast("string")
    door = hit(own, 30, "shop", plate, town, 6.2, -75.6)
    long_piece = hit(own, 26, "highway", nothing, town, 6.2, -75.6, 0.02, 0.0001)
    short_piece = hit(own, 26, "highway", nothing, town, 6.2, -75.6, 0.001, 0.001)
    elsewhere = hit(own, 26, "highway", nothing, F.lit("Cali"), 3.4, -76.5)
    asked = targets.where("target_problem is null")
    hits = (
        F.when(size < 20, F.array(elsewhere)).when(size < 30, F.array(long_piece, door)).when(size < 40, F.array(long_piece)).otherwise(F.array(short_piece))
    )
    at = F.lit("2026-09-01").cast("timestamp").alias("fetched_at")
    address = asked.where(size >= 10).select(
        F.col("address_query").alias("query"), F.lit("every").alias("shape"), at, F.lit(1).alias("raw_count"), hits.alias("hits")
    )
    corner = hit(F.lit("Calle 50"), 26, "highway", nothing, town, 6.2005, -75.601, 0.0001, 0.002)
    cross = asked.where(size.between(30, 39)).select(
        F.col("cross_query").alias("query"), F.lit("every").alias("shape"), at, F.lit(1).alias("raw_count"), F.array(corner).alias("hits")
    ).dropDuplicates(["query"])
    # only corners look at the cross street here, so the other sizes do not meet it
    answers = gc.combine_answers(address.unionByName(cross), F.lit("2026-10-01").cast("timestamp"))
    with_cross = targets.withColumn("cross_query", F.when(size.between(30, 39), F.col("cross_query")))
    return gc.resolve_locations(with_cross, answers)


@query(
    "combined_answers",
    """with a as (select 'q'||l_partkey as query, l_returnflag='R' as folded, to_timestamp(epoch(l_shipdate)+l_orderkey*8+l_linenumber) as fetched_at,
          case when l_linenumber>3 then 40 else 2 end as raw_count, [(l_suppkey)||':'||l_linenumber, (l_suppkey+1)||':'||l_linenumber] as hits, l_orderkey, l_linenumber
          from lineitem),
       fresh as (select * from a where fetched_at > (select to_timestamp(epoch(max(l_shipdate))) from lineitem) - interval 180 days),
       e as (select query, arg_max({'h': hits, 'n': raw_count}, fetched_at) as x from fresh where not folded group by 1),
       f as (select query, arg_max(hits, fetched_at) as h from fresh where folded group by 1)
       select e.query, e.x.n>=40 as truncated, array_to_string(list_concat(e.x.h, case when e.x.n>=40 and f.h is not null
         then list_filter(f.h, lambda y: not list_contains(e.x.h, y)) else []::varchar[] end), ',') as hits from e left join f on f.query=e.query""",
)
def combined_answers(spark, sf):
    """Lines are answers: older than 180 days, folded, cut at the limit, or plain; a question is a product."""
    lines = v.read(spark, sf, "lineitem")
    none, number = F.lit(None).cast("string"), F.col("l_linenumber").cast("double")

    def hit(more: int):
        lat = (F.col("l_suppkey") + more).cast("double")
        return F.struct(
            lat.alias("lat"), number.alias("lon"), F.lit(26).alias("place_rank"), F.lit("highway").alias("category"), none.alias("type"), none.alias("name"),
            F.create_map(F.lit("road"), F.lit("x")).alias("address"), F.array(lat, number).alias("boundingbox"))

    at = F.timestamp_seconds(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    answers = lines.select(
        F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("query"), F.when(F.col("l_returnflag") == "R", "folded").otherwise("every").alias("shape"),
        at.alias("fetched_at"), F.when(F.col("l_linenumber") > 3, 40).otherwise(2).alias("raw_count"), F.array(hit(0), hit(1)).alias("hits"))
    latest = lines.agg(F.max(F.col("l_shipdate").cast("timestamp"))).first()[0]
    combined = gc.combine_answers(answers, F.lit(latest))
    label = F.transform("hits", lambda h: F.concat(h["lat"].cast("long").cast("string"), F.lit(":"), h["lon"].cast("long").cast("string")))
    return combined.select("query", "truncated", F.array_join(label, ",").alias("hits"))


# --- reminders ----------------------------------------------------------------------------------------------------

NOW = "2026-10-03 12:00:00"
REMIND = """remind as (select o_orderkey as list_id, o_custkey as owner_id, case o_orderstatus when 'F' then 'weekly' when 'O' then 'biweekly'
  else 'monthly' end as frequency, 1+o_custkey%7 as weekday, 1+o_orderkey%31 as day_of_month,
  case when o_orderpriority like '1%' then '12:00' else '08:00' end as t, cast(o_orderdate as date) as anchor from orders
  where o_orderpriority<>'5-LOW')"""
DUE = f"""due as (select list_id, owner_id, due_at from (select *, row_number() over (partition by list_id order by due_at) n from (
  select list_id, owner_id, d + t::time as due_at from (
    select list_id, owner_id, t, date '2026-10-03' + cast((weekday - 6 + 7)%7 + 7*k as integer) as d from remind, range(0, 10) r(k) where frequency='weekly'
    union all select list_id, owner_id, t, anchor + cast(14*k + 14*((date '2026-10-03' - anchor)//14) as integer) as d from remind, range(-1, 11) r(k) where frequency='biweekly'
    union all select list_id, owner_id, t, cast(least(m + cast(day_of_month-1 as integer), last_day(m)) as date) as d from (
      select *, cast(date '2026-10-01' + to_months(k::integer) as date) as m from remind, range(0, 10) r(k) where frequency='monthly')))
  where due_at > timestamp '{NOW}') where n<=8)"""


def _reminders(spark, sf):
    orders = v.read(spark, sf, "orders")
    status = F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("list_id"), F.col("o_custkey").alias("owner_id"),
        F.when(status == "F", "weekly").when(status == "O", "biweekly").otherwise("monthly").alias("frequency"),
        (1 + F.col("o_custkey") % 7).cast("int").alias("weekday"), (1 + F.col("o_orderkey") % 31).cast("int").alias("day_of_month"),
        F.when(F.startswith("o_orderpriority", F.lit("1")), "12:00").otherwise("08:00").alias("time_local"),
        F.col("o_orderdate").cast("date").alias("anchor_date"), (F.col("o_orderpriority") != "5-LOW").alias("is_enabled"),
    )


@query("reminder_occurrences", with_ctes("select list_id, strftime(due_at, '%Y-%m-%d %H:%M') as due_at from due", REMIND, DUE))
def reminder_occurrences(spark, sf):
    due = rm.expand_occurrences(_reminders(spark, sf), F.lit(NOW))
    return due.select("list_id", F.date_format("due_at", "yyyy-MM-dd HH:mm").alias("due_at"))


@query(
    "plan_notifications",
    with_ctes(
        """select owner_id, list_id, identifier, rank, '"'||o_orderpriority||'" · '||case when coalesce(n,0)=1 then '1 producto' else coalesce(n,0)||' productos' end
          ||' · ~$'||chr(160)||replace(format('{:,}', coalesce(total,0)),',','.') as body from (
        select *, 'reminder:'||list_id||':'||strftime(due_at,'%Y%m%d%H%M') as identifier, row_number() over (partition by owner_id
          order by due_at, 'reminder:'||list_id||':'||strftime(due_at,'%Y%m%d%H%M')) as rank from due
          where list_id in (select o_orderkey from orders where o_orderstatus<>'F'))
        join orders on o_orderkey=list_id left join (select list_id as k, cast(sum(item_count) as bigint) as n, cast(sum(subtotal_cop) as bigint) as total
          from lt group by 1) on k=list_id where rank<=56""",
        REMIND, DUE, SNAP, CUR, ITEM, PROF, PRICED, LT,
    ),
)
def plan_notifications(spark, sf):
    from larder.plans.price_queries import list_summary

    plan = rm.plan_notifications(_reminders(spark, sf), list_summary(spark, sf), F.lit(NOW))
    return plan.select("owner_id", "list_id", "identifier", "rank", "body")


@query(
    "reconcile_notifications",
    with_ctes(
        """select 'reminder:'||o_orderkey||':202610100800' as identifier, o_orderkey::varchar as list_id, '2026-10-10 08:00' as due_at from orders
        where 'reminder:'||o_orderkey||':202610100800' not in (select 'reminder:'||list_id||':'||strftime(due_at,'%Y%m%d%H%M') from due)""",
        REMIND, DUE,
    ),
)
def reconcile_notifications(spark, sf):
    due = rm.expand_occurrences(_reminders(spark, sf), F.lit(NOW))
    planned = due.select(rm.notification_id(F.col("list_id"), F.col("due_at")).alias("identifier"))
    orders = v.read(spark, sf, "orders")
    scheduled = orders.select(F.concat(F.lit("reminder:"), F.col("o_orderkey").cast("string"), F.lit(":202610100800")).alias("identifier"))
    other = orders.select(F.concat(F.lit("other:"), F.col("o_orderkey").cast("string")).alias("identifier"))
    cancel, _ = rm.reconcile(planned, scheduled.unionByName(other))
    return rm.parse_identifiers(cancel, "[0-9]+").withColumn("due_at", F.date_format("due_at", "yyyy-MM-dd HH:mm"))


@query(
    "anchor_dates",
    """select o_orderkey as list_id, case when o_orderstatus='O' then case when o_orderpriority='1-URGENT' then cast(o_orderdate as date)
       else date '2026-10-03' + cast((1+o_custkey%7 - 6 + 7)%7 as integer) end end as anchor_date from orders""",
)
def anchor_dates(spark, sf):
    drafts = _reminders(spark, sf).select("list_id", "frequency", "weekday")
    previous = v.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("list_id"), F.lit("biweekly").alias("frequency"), (1 + F.col("o_custkey") % 7).cast("int").alias("weekday"),
        F.col("o_orderdate").cast("date").alias("anchor_date"),
    )
    return rm.anchor_dates(drafts, previous, F.lit("2026-10-03").cast("date")).select("list_id", "anchor_date")


# --- trips --------------------------------------------------------------------------------------------------------


def _track(spark, sf):
    """A user's events as positions in time: the value moves them along, the id sideways."""
    return v.read(spark, sf, "events").select(
        F.col("user_id").alias("trip_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("ts").cast("timestamp").alias("ts"), (4.5 + F.col("value") / 1000).alias("lat"),
        (-74.0 + F.col("event_id") / 100000).alias("lng"), F.col("value").alias("off_route_m"), "event_type",
    )


TRACK = """track as (select user_id as trip_id, event_id, ts, 4.5::double+value/1000 as lat, -74.0::double+event_id/100000 as lng, value from events)"""


@query(
    "route_tail",
    with_ctes(
        f"""select trip_id, event_id, cast(round(leg) as bigint) as length_m, cast(round(sum(leg) over (partition by trip_id order by ts desc, event_id desc)/100) as bigint)
        as remaining_hm from (select *, case when latitude is null then 0.0 else {METRES} end as leg from (select *, lead(lat) over w as latitude, lead(lng) over w as longitude
          from track window w as (partition by trip_id order by ts, event_id)))""",
        TRACK,
    ),
)
def route_tail(spark, sf):
    tail = tr.remaining_along(_track(spark, sf), ["trip_id"], F.col("at"))
    return tail.select(
        "trip_id", "event_id", F.round("length_m").cast("bigint").alias("length_m"),
        F.round(F.col("remaining_m") / 100).cast("bigint").alias("remaining_hm"),
    )


@query(
    "off_route_runs",
    """select user_id as trip_id, event_id, coalesce(count(*) over w = 3 and min(value) over w > 50, false) as off_route from events
       window w as (partition by user_id order by ts, event_id rows between 2 preceding and current row)""",
)
def off_route_runs(spark, sf):
    runs = tr.off_route_runs(_track(spark, sf), "trip_id", [F.col("at"), F.col("event_id")], F.col("at"))
    return runs.select("trip_id", "event_id", "off_route")


@query(
    "arrivals",
    with_ctes(
        f"""select trip_id, epoch_us(min(ts)) as arrived_at from (select trip_id, ts, {METRES} as m from (select track.*, s.lat as latitude, s.lng as longitude
        from track join (select trip_id, max(lat) as lat, arg_max(lng, lat) as lng from track group by 1) s using (trip_id))) where m<=30 group by 1""",
        TRACK,
    ),
)
def arrivals(spark, sf):
    track = _track(spark, sf)
    shops = track.groupBy("trip_id").agg(F.max(F.struct("lat", "lng")).alias("s")).select(
        "trip_id", F.col("s.lat").alias("shop_lat"), F.col("s.lng").alias("shop_lng")
    )
    return tr.arrivals(track, shops).select("trip_id", F.unix_micros("arrived_at").alias("arrived_at"))


def _routes(spark, sf):
    """Each order's lines, in order, are the vertices of its route."""
    line = v.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("route_id"), "l_linenumber", "l_partkey",
        (4.5 + F.col("l_quantity") / 1000).alias("lat"), (-74.0 + F.col("l_suppkey") / 10000).alias("lng"),
    )
    vertex = F.struct("l_linenumber", "l_partkey", "lng", "lat")
    return line.groupBy("route_id").agg(F.array_sort(F.collect_list(vertex)).alias("v")).select(
        "route_id", F.transform("v", lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("coordinates"),
        F.lit(1000).alias("distance_m"), F.lit(600).alias("duration_s"),
    )


@query(
    "route_bounds",
    """select l_orderkey as route_id, min(-74.0::double+l_suppkey/10000) as west, min(4.5::double+l_quantity/1000) as south,
       max(-74.0::double+l_suppkey/10000) as east, max(4.5::double+l_quantity/1000) as north from lineitem group by 1""",
)
def route_bounds(spark, sf):
    return tr.route_bounds(_routes(spark, sf))


@query(
    "route_segments",
    f"""with p as (select l_orderkey as route_id, row_number() over w - 1 as segment, 4.5::double+l_quantity/1000 as lat, -74.0::double+l_suppkey/10000 as lng,
         lead(4.5::double+l_quantity/1000) over w as latitude, lead(-74.0::double+l_suppkey/10000) over w as longitude from lineitem
         window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)),
       m as (select *, {METRES} as leg from p where latitude is not null)
       select route_id, segment, cast(round(leg) as bigint) as length_m,
         cast(round(sum(leg) over (partition by route_id order by segment desc)) as bigint) as remaining_m from m""",
)
def route_segments(spark, sf):
    rounded = lambda c: F.round(c).cast("bigint").alias(c)
    return tr.route_segments(_routes(spark, sf)).select("route_id", "segment", rounded("length_m"), rounded("remaining_m"))


@query("match_fixes")
def match_fixes(spark, sf):
    """Customers' orders as trips: the lines of an order are its fixes, and the route is the order's own."""
    start = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 10
    fixes = v.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("trip_id"), F.col("l_orderkey").cast("string").alias("route_id"),
        F.timestamp_seconds(start).alias("ts"), (4.5 + F.col("l_quantity") / 1000 + F.col("l_tax") / 50).alias("lat"),
        (-74.0 + F.col("l_suppkey") / 10000).alias("lng"),
    )
    routes = _routes(spark, sf).withColumn("route_id", F.col("route_id").cast("string"))
    return tr.match_fixes(fixes, routes)


# --- streams ------------------------------------------------------------------------------------------------------


def _scratch(spark, name: str) -> str:
    """A new folder in the session's shared folder."""
    return os.path.join(shared_folder(spark), "larder", name, spark.sparkContext.applicationId, str(abs(hash(os.urandom(8)))))


@query(
    "price_change_stream",
    """with recursive """ + SNAP + """,
      r as (select *, row_number() over (partition by store_product_id, region_code order by captured_at, price_cop) as rn from snap),
      f as (select store_product_id, region_code, captured_at, rn, price_cop, null::integer as previous_cop, 'new' as decision, price_cop as held
          from r where rn=1
        union all select store_product_id, region_code, captured_at, rn, price_cop, held, d, case when d in ('same','jump') then held else price_cop end
          from (select r.*, f.held, case when r.price_cop=f.held then 'same' when r.price_cop>=f.held*10 or r.price_cop*10<=f.held then 'jump'
            else 'changed' end as d from f join r on r.store_product_id=f.store_product_id and r.region_code=f.region_code and r.rn=f.rn+1))
      select store_product_id::varchar as store_product_id, region_code, strftime(captured_at, '%Y-%m-%d %H:%M:%S') as captured_at, price_cop,
        previous_cop, decision from f where decision<>'same'""",
)
def price_change_stream(spark, sf):
    """Lines stream in, the detector keeps the last accepted price by product and region; every change and jump comes out."""
    batch = v.read(spark, sf, "lineitem")
    lines = spark.readStream.schema(batch.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    staged = lines.select(
        F.col("l_partkey").cast("string").alias("store_product_id"), v._region("l_linenumber").alias("region_code"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("int").alias("price_cop"),
        F.lit(None).cast("int").alias("list_price_cop"), F.col("l_shipdate").cast("timestamp").alias("captured_at"),
    )
    folder = _scratch(spark, "changes")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    try:
        buckets = jobs.state_buckets(batch.count())
        jobs.start_price_changes(staged, f"{folder}/out", f"{folder}/checkpoint", buckets=buckets).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    changes = spark.read.schema(jobs.CHANGES).parquet(f"{folder}/out")
    stamp = F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at")
    return changes.select("store_product_id", "region_code", stamp, "price_cop", "previous_cop", "decision")


@query(
    "publish_stream",
    with_ctes("select store_product_id, region_code, price_cop from cur", SNAP, CUR),
)
def publish_stream(spark, sf):
    """Snapshots stream in over the prices published before a middle date; every micro-batch publishes a new version."""
    batch = v.read(spark, sf, "lineitem")
    lines = spark.readStream.schema(batch.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    snapshots = lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("store_product_id"),
        v._region("l_linenumber").alias("region_code"), F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("int").alias("price_cop"),
        F.round(F.col("l_extendedprice") * (1 + F.col("l_tax")) / F.col("l_quantity")).cast("int").alias("list_price_cop"),
        F.col("l_shipdate").cast("timestamp").alias("captured_at"),
    )
    folder = _scratch(spark, "publish")
    history = v.snapshots(spark, sf)
    middle = history.agg(F.avg(F.unix_seconds("captured_at"))).first()[0]
    seed = pr.latest_price(history.where(F.unix_seconds("captured_at") < F.lit(middle)))
    stream = jobs.publish_batches(snapshots, f"{folder}/current", f"{folder}/checkpoint", seed, buckets=buckets_for(history.count()))
    stream.awaitTermination()
    last = stream.lastProgress["batchId"] if stream.lastProgress else 0  # no batch: what was seeded
    return jobs.published(spark, f"{folder}/current", last).select("store_product_id", "region_code", "price_cop")


#: Micro-batches that the later half of the history is dealt over, whatever its size.
LANDINGS = 6


@query(
    "publish_batches",
    with_ctes(
        """select store_product_id, region_code, price_cop, list_price_cop, id, strftime(captured_at, '%Y-%m-%d') as captured_on from (
          select *, row_number() over (partition by store_product_id, region_code
            order by captured_at desc, id desc, price_cop desc, list_price_cop desc) rn from snap) where rn=1""",
        SNAP,
    ),
)
def publish_batches(spark, sf):
    """Prices up to a middle date are published; later ones land by month and stream in over several micro-batches."""
    folder = _scratch(spark, "batches")
    history = v.snapshots(spark, sf)
    middle = history.agg(F.avg(F.unix_seconds("captured_at"))).first()[0]
    later = F.unix_seconds("captured_at") >= F.lit(middle)
    month = F.date_format("captured_at", "yyyy-MM").alias("month")
    history.where(later).select("*", month).hint("rebalance", "month").write.partitionBy("month").parquet(f"{folder}/landed")
    none = history.select("id", *pr.CURRENT).limit(0)
    seed = pr.publish_rows(none, history.where(~F.coalesce(later, F.lit(False))))
    files = len(spark.read.schema(history.schema).parquet(f"{folder}/landed").inputFiles())
    stream = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", max(1, files // LANDINGS)).parquet(f"{folder}/landed")
    buckets = buckets_for(history.count())
    jobs.publish_batches(stream, f"{folder}/current", f"{folder}/checkpoint", seed, pr.publish_rows, buckets).awaitTermination()
    day = F.date_format("captured_at", "yyyy-MM-dd").alias("captured_on")
    return jobs.published(spark, f"{folder}/current").select(*pr.KEY, "price_cop", "list_price_cop", "id", day)
