"""Registered queries: text, sizes, names, aisles, raw records, gates, constraints, catalogue upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import money
from larder.functions.money import lookup
from larder.functions.rules import Rule, load_rules
from larder.functions.text import fold_text, html_to_text
from larder.operators import catalog as cat
from larder.operators import classify as cl
from larder.operators import measure as ms
from larder.operators import normalize as nz
from larder.operators import quality as q
from larder.plans import views as v
from larder.plans.registry import query
from larder.plans.views import with_ctes
from larder.session import shared_folder


@query("text_normalise", "select doc_id, md5(strip_accents(lower(text))) as folded from documents")
def text_normalise(spark, sf):
    docs = v.read_spread(spark, sf, "documents", "doc_id", "text")
    return fold_text(docs, "text").select("doc_id", F.md5("text_folded").alias("folded"))




@query(
    "html_text",
    """select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
       regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&amp;', '&amp' || chr(1), 'gi'), '&quot;', '"', 'gi'),
       '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&amp' || chr(1), '&', 'gi'), '[“”"]', '', 'g'),
       '[\\s\\x{00a0}]+', ' ', 'g'))) as text from pages""",
)
def html_text(spark, sf):
    return v.read_spread(spark, sf, "pages", "page_id", "html").select("page_id", F.md5(html_to_text(F.col("html"))).alias("text"))


# name of a product with its size written the way its type writes it
SIZED = """sized as (select p_partkey, p_type, p_size, case p_type
  when 'ECONOMY' then p_name||' '||p_size||' gr' when 'LARGE' then p_name||' (granel) ('||p_size||'  KG)'
  when 'MEDIUM' then p_name||' '||p_size||' x 330 ml' when 'PROMO' then p_name||' '||p_size||'.500 Ml'
  when 'SMALL' then p_name||' x '||p_size||' und' else p_name||' '||p_size||'-'||(p_size+5)||' Kg' end as name from part)"""


def _sized(spark, sf):
    name, size, kind = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_type")
    named = (
        F.when(kind == "ECONOMY", F.concat(name, F.lit(" "), size, F.lit(" gr")))
        .when(kind == "LARGE", F.concat(name, F.lit(" (granel) ("), size, F.lit("  KG)")))
        .when(kind == "MEDIUM", F.concat(name, F.lit(" "), size, F.lit(" x 330 ml")))
        .when(kind == "PROMO", F.concat(name, F.lit(" "), size, F.lit(".500 Ml")))
        .when(kind == "SMALL", F.concat(name, F.lit(" x "), size, F.lit(" und")))
        .otherwise(F.concat(name, F.lit(" "), size, F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit(" Kg")))
    )
    return v.read(spark, sf, "part").select("p_partkey", named.alias("name"))


@query(
    "extract_measures",
    with_ctes(
        """select p_partkey, name, case when m in ('g','kg') then 'weight' when m in ('ml','l') then 'volume' else 'unit' end
        as unit_kind, val as unit_value, m as unit_measure from (select *, case when val is not null then unit end as m from (
        select *, case p_type when 'ECONOMY' then 'g' when 'LARGE' then 'kg' when 'PROMO' then 'ml' when 'SMALL' then 'un' end
          as unit, (case when p_type='ECONOMY' and p_size>=3 then p_size when p_type='LARGE' then p_size
          when p_type='PROMO' and p_size*1000+500<=25000 then p_size*1000+500 when p_type='SMALL' then p_size end)::double
          as val from sized))""",
        SIZED,
    ),
)
def extract_measures(spark, sf):
    return ms.extract_measures(_sized(spark, sf)).withColumn("unit_value", F.col("unit_value").cast("double"))


@query(
    "extract_measures_erp",
    """select p_partkey, val as unit_value, case when val is not null then unit end as unit_measure,
       case when val is not null then token end as size_token from (select *,
       case p_type when 'ECONOMY' then 'g' when 'LARGE' then 'ml' when 'PROMO' then 'un' end as unit,
       case p_type when 'ECONOMY' then (p_size*10)||'G' when 'LARGE' then (p_size*10)||'M' when 'PROMO' then p_size||'U' end as token,
       (case when p_type='ECONOMY' then p_size*10 when p_type='LARGE' and p_size*10>=100 then p_size*10
         when p_type='PROMO' then p_size end)::double as val from part)""",
)
def extract_measures_erp(spark, sf):
    ten, size, kind = (F.col("p_size") * 10).cast("string"), F.col("p_size").cast("string"), F.col("p_type")
    title = F.upper(
        F.when(kind == "ECONOMY", F.concat("p_name", F.lit(" "), ten, F.lit("G ESPECIAL")))
        .when(kind == "LARGE", F.concat("p_name", F.lit(" "), ten, F.lit("M")))
        .when(kind == "PROMO", F.concat("p_name", F.lit(" "), size, F.lit("U")))
        .when(kind == "SMALL", F.concat("p_name", F.lit(" "), size, F.lit("U 144G")))
        .when(kind == "MEDIUM", F.concat("p_name", F.lit(" X3 "), ten, F.lit("G")))
        .otherwise(F.concat("p_name", F.lit(" 3 "), ten, F.lit("G")))
    )
    titles = v.read(spark, sf, "part").select("p_partkey", title.alias("title"), F.lit("viveres").alias("aisle"))
    return ms.extract_measures_erp(titles).select(
        "p_partkey", F.col("unit_value").cast("double").alias("unit_value"), "unit_measure", "size_token"
    )


@query(
    "clean_names",
    """select p_partkey, upper(left(t,1))||substr(t,2) as clean_name from (select p_partkey,
       case when p_type='PROMO' then p_brand||' '||p_name when p_type='SMALL' then 'Caja '||p_brand||' 12g' else p_name end as t from part)""",
)
def clean_names(spark, sf):
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    named = (
        F.when(F.col("p_type") == "PROMO", F.concat_ws(" ", "p_brand", "p_name"))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("Caja "), "p_brand", F.lit(" 12g")))
        .otherwise(F.concat_ws("  ", first, F.upper("p_brand"), last, F.concat(F.lit("("), "p_size", F.lit(" gr)"))))
    )
    parts = v.read(spark, sf, "part").select("p_partkey", named.alias("name"), F.col("p_brand").alias("brand"))
    return ms.clean_names(parts).select("p_partkey", "clean_name")


@query(
    "clean_brands",
    """select c_custkey, case when c_mktsegment in ('FURNITURE','HOUSEHOLD') then null
       else upper(left(c_mktsegment,1))||lower(substr(c_mktsegment,2))||' '||c_custkey end as clean_brand from customer""",
)
def clean_brands(spark, sf):
    segment, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    brand = (
        F.when(segment == "FURNITURE", F.concat(F.lit(" SIN  marca "), key))
        .when(segment == "HOUSEHOLD", F.concat(F.col("c_nationkey").cast("string"), F.lit("."), key))
        .otherwise(F.concat(segment, F.lit("   "), key))
    )
    rows = v.read(spark, sf, "customer").select("c_custkey", brand.alias("brand"))
    return ms.clean_brands(rows).select("c_custkey", "clean_brand")


@query(
    "parse_prices",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice+0.5) as bigint) as price_cop,
       l_extendedprice=floor(l_extendedprice) as readable,
       case when l_extendedprice=floor(l_extendedprice) then cast(l_extendedprice as bigint) end as text_cop,
       cast(l_quantity as bigint) as quantity_cop from lineitem""",
)
def parse_prices(spark, sf):
    lines = v.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("l_extendedprice").cast("decimal(15,2)").cast("string").alias("t"), F.col("l_quantity").cast("string").alias("n"),
    )
    return ms.parse_prices(lines, "l_extendedprice").withColumns(
        {
            "readable": money.text_price_readable(F.col("t")),
            "text_cop": money.text_price(F.col("t")),
            "quantity_cop": money.text_price(F.col("n")),
        }
    ).drop("t", "n", "l_extendedprice")


TAGS = [
    Rule("tag", "token", "secret"), Rule("tag", "license*", "license"), Rule("tag", "ción*", "es"), Rule("tag", "der", "de"),
    Rule("tag", "und", "de"), Rule("tag", "les", "fr"), Rule("tag", "que", "romance"), Rule("tag", "el", "es"), Rule("tag", "la", "romance"),
    Rule("tag", "of", "en"), Rule("tag", "the", "en"), Rule("tag", "with*", "en"),
]


def _tag_sql(text: str, rules: list[Rule]) -> str:
    cases = []
    for r in rules:
        word = r.keyword.replace("ó", "o")
        pattern = rf"\b{word[:-1]}" if word.endswith("*") else rf"\b{word}(?:e?s)?\b"
        cases.append(f"when regexp_matches({text}, '{pattern}') then '{r.slug}'")
    return "case " + " ".join(cases)


@query(
    "keyword_tags",
    f"select doc_id, {_tag_sql('t', TAGS)} when lang='fr' then 'fr' else 'other' end as tag"
    " from (select doc_id, lang, strip_accents(lower(text)) as t from documents)",
)
def keyword_tags(spark, sf):
    docs = v.read_spread(spark, sf, "documents", "doc_id", "lang", "text")
    return cl.tag_by_keywords(docs, "text", TAGS, {"fr": "fr"}, "lang", "other").select("doc_id", "tag")


LAYERS = cl.Taxonomy(
    rules=(
        Rule("pets", "old anvil", "pets"), Rule("non_food", "hot gear", "tools"), Rule("closed:LARGE", "red", "given back"),
        Rule("frozen", "cold*", "frozen"), Rule("exceptions", "new ring", "jewels"), Rule("head", "small", "minor", (("PROMO", "offers"),)),
        Rule("form", "plate", "plates"), Rule("produce", "bolt", "bolts"), Rule("produce", "blue", "blues"),
        Rule("ingredient", "widget", "widgets"), Rule("ingredient", "gizmo*", "gizmos"),
    ),
    authoritative=("ECONOMY",), closed=("LARGE",), fresh="SMALL", fallback=(("ECONOMY", "cheap"), ("LARGE", "big")), default="rest",
)
LAYER_SQL = r"""case when bucket='ECONOMY' then 'cheap' when t like '% old anvil%' then 'pets' when t like '% hot gear%' then 'tools'
  when bucket='LARGE' then case when t like ' red %' then 'given back' else 'big' end
  when t like '% cold%' then 'frozen' when t like '% new ring%' then 'jewels'
  when t like ' small %' then case when bucket='PROMO' then 'offers' else 'minor' end when t like '% plate %' then 'plates'
  when bucket='SMALL' and t like '% blue %' then 'blues' when bucket='SMALL' and t like '% bolt %' then 'bolts'
  when t like '% widget %' then 'widgets' when t like '% gizmo%' then 'gizmos'
  when bucket is null and t like '% blue %' then 'blues' when bucket is null and t like '% bolt %' then 'bolts' else 'rest' end"""
BUCKETED = """bucketed as (select p_partkey, ' '||p_name||' ' as t, case when p_type<>'STANDARD' then p_type end as bucket from part)"""


def _bucketed(spark, sf):
    return v.read(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_type") != "STANDARD", F.col("p_type")).alias("source_bucket")
    )


@query("classify_layers", with_ctes(f"select p_partkey, {LAYER_SQL} as category_slug from bucketed", BUCKETED))
def classify_layers(spark, sf):
    return cl.classify(_bucketed(spark, sf), LAYERS).select("p_partkey", "category_slug")


#: What a part's two words, and its type as the source's bucket, stand for in the shipped rules.
STARTER_NOUNS = {"widget": "Queso", "gear": "Galletas", "bolt": "Papa", "ring": "Helado", "rod": "Cosa", "plate": "Arroz", "gizmo": "Detergente", "anvil": "MASCOTA"}
STARTER_WORDS = {"red": "tomate", "hot": "pimienta", "cold": "congelado", "small": "pequeña", "large": "grande", "new": "nueva", "old": "viejo", "blue": "azul"}
STARTER_BUCKETS = {"ECONOMY": "frutas-verduras", "LARGE": "congelados", "MEDIUM": "viveres", "PROMO": "lacteos", "STANDARD": "mascotas"}


@query(
    "classify_starter",
    """with p as (select p_partkey, p_type as t, split_part(p_name,' ',1) as a, split_part(p_name,' ',2) as n from part)
      select p_partkey, case when t='STANDARD' or n='anvil' then 'mascotas' when n='gizmo' then 'aseo-hogar'
        when t='LARGE' or n='ring' or a='cold' then 'congelados' when n='gear' then 'galletas'
        when n='bolt' then case when t in ('ECONOMY','SMALL') then 'verduras' else 'snacks' end
        when t='ECONOMY' and a='red' then 'verduras' when n='widget' then 'quesos' when n='plate' then 'arroz' when a='hot' then 'sal-condimentos'
        when t='SMALL' and a='red' then 'verduras' when t='ECONOMY' then 'verduras' when t='PROMO' then 'leche' else 'otros' end as category_slug from p""",
)
def classify_starter(spark, sf):
    """Every product under a shop's words for its own: the shipped rules file it."""
    word = lambda k, names: lookup(F.split_part("p_name", F.lit(" "), F.lit(k)), names)
    name = F.concat_ws(" ", word(2, STARTER_NOUNS), word(1, STARTER_WORDS), "p_size", F.lit("g"))
    named = v.read(spark, sf, "part").select("p_partkey", name.alias("name"), lookup(F.col("p_type"), STARTER_BUCKETS).alias("source_bucket"))
    return cl.classify(named).select("p_partkey", "category_slug")


def _rule_rows(spark, sf):
    """A shop's rule table: a rule for each product name of a brand that stocks its own aisle, one for each name, one for each noun."""
    part = v.read(spark, sf, "part").select("p_name", F.concat(F.lit("b"), F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("brand"), "p_brand").distinct()
    own = part.select(F.lit("exceptions").alias("layer"), F.concat_ws(" ", "p_name", "brand").alias("keyword"), F.concat(F.lit("own-"), "brand").alias("slug"))
    own = own.where(~F.col("slug").isin("own-b1", "own-b2"))
    head = part.select(F.lit("head").alias("layer"), F.col("p_name").alias("keyword"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug")).distinct()
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    stem = part.select(F.lit("ingredient").alias("layer"), F.concat(F.substring(noun, F.lit(1), F.length(noun) - 1), F.lit("*")).alias("keyword"), noun.alias("slug")).distinct()
    rows = own.unionByName(head.where("keyword not like 'hot %'")).unionByName(stem)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("layer").orderBy("keyword")))


@query(
    "classify_rule_table",
    """with p as (select p_partkey, p_name, split_part(p_brand,'#',2) as b, p_size%2=0 as many from part)
      select p_partkey, case when not many and b not in ('1','2') then 'own-b'||b when p_name not like 'hot %' then replace(p_name,' ','-')
        else split_part(p_name,' ',2) end as category_slug from p""",
)
def classify_rule_table(spark, sf):
    """A rule table of more than a thousand rules, read from a file, files every product; half of the names are plurals."""
    folder = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    _rule_rows(spark, sf).write.json(folder)
    taxonomy = cl.Taxonomy(tuple(load_rules(spark, folder)), (), (), "", (), "none")
    name = F.concat_ws(" ", F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "s").otherwise("")), F.replace("p_brand", F.lit("Brand#"), F.lit("b")), "p_size")
    named = v.read(spark, sf, "part").select("p_partkey", F.upper(name).alias("name"), F.lit(None).cast("string").alias("source_bucket"))
    return cl.classify(named, taxonomy).select("p_partkey", "category_slug")


@query("classify_documents")
def classify_documents(spark, sf):
    """The starter rules over whole documents: the cost of the real layer count on long texts."""
    docs = v.read_spread(spark, sf, "documents", "doc_id", "text").select("doc_id", F.col("text").alias("name"), F.lit(None).cast("string").alias("source_bucket"))
    return cl.classify(docs).groupBy("category_slug").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "reclassify_moves",
    with_ctes(
        f"""select before, after, count(*) as products from (select split_part(trim(t),' ',2) as before, {LAYER_SQL} as after
        from bucketed) where before<>after group by 1,2 order by 3 desc, 1, 2 limit 15""",
        BUCKETED,
    ),
)
def reclassify_moves(spark, sf):
    stored = _bucketed(spark, sf).withColumn("category_slug", F.split_part("name", F.lit(" "), F.lit(2)))
    return cl.moves(cl.reclassify(stored, LAYERS))


@query(
    "describe_presentations",
    """with p as (select p_partkey, p_size, case p_type when 'ECONOMY' then 'g' when 'LARGE' then 'kg' when 'MEDIUM' then 'ml'
       when 'PROMO' then 'l' when 'SMALL' then 'un' end as m, p_size*100 as val from part),
     l as (select *, case when m in ('g','ml') and val>=1000 then replace(rtrim(rtrim(printf('%.3f', val/1000.0),'0'),'.'),'.',',')||case m when 'g' then ' kg' else ' L' end
       else val||' '||case m when 'l' then 'L' else m end end as one,
       case when m in ('g','ml') and val*3>=1000 then replace(rtrim(rtrim(printf('%.3f', val*3/1000.0),'0'),'.'),'.',',')||case m when 'g' then ' kg' else ' L' end
       else val*3||' '||case m when 'l' then 'L' else m end end as three from p)
     select p_partkey, case when m is null then 'Unidad' when m='un' then 'Paquete x '||val when m in ('ml','l') then 'Envase '||one
       else 'Paquete '||one end as presentation, three as total_content,
       '3 '||case when m is null then 'unidades' when m in ('ml','l') then 'envases' else 'paquetes' end as quantity_label from l""",
)
def describe_presentations(spark, sf):
    products = v.products(spark, sf).select(
        F.col("id").alias("p_partkey"), "name", "unit_kind", (F.col("unit_value") * 100).alias("unit_value"), "unit_measure",
        F.lit(3).alias("quantity"),
    )
    return cl.describe_presentations(products, "quantity").select("p_partkey", "presentation", "total_content", "quantity_label")


# --- raw records --------------------------------------------------------------------------------------------------


@query(
    "dedupe_first",
    """select l_partkey, l_orderkey, l_linenumber, l_suppkey from (select *, row_number() over (partition by l_partkey
       order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity) rn from lineitem) where rn=1""",
)
def dedupe_first(spark, sf):
    lines = v.read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    return nz.dedupe_first(lines, ["l_partkey"], order).drop("l_shipdate", "l_quantity")


@query(
    "truncated_aisles",
    """select l_returnflag as store, l_suppkey::varchar as aisle, 'dropped' as outcome from (select l_returnflag, l_suppkey,
       max(l_linenumber*10) as page, arg_max(l_quantity, l_linenumber*1000+l_quantity) as records from lineitem group by 1,2)
       where page*50>=2500 and records>=50""",
)
def truncated_aisles(spark, sf):
    log = v.read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("store"), F.col("l_suppkey").cast("string").alias("aisle_id"),
        (F.col("l_linenumber") * 10).alias("page_no"), F.col("l_quantity").cast("int").alias("records"), F.lit("").alias("url"),
    )
    aisles = log.select("store", "aisle_id", F.col("aisle_id").alias("label")).distinct()
    return nz.truncated_aisles(log, aisles).select(
        "store", F.regexp_extract("reason", r": (.*)$", 1).alias("aisle"), "outcome"
    )


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
RAW = """raw as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, p_name, p_brand, p_type,
  cast(floor(l_extendedprice/l_quantity+0.5) as integer) as cop from lineitem join part on p_partkey=l_partkey)"""


@query(
    "normalize_vtex",
    with_ctes(
        """select l_orderkey, l_linenumber, l_suppkey, l_partkey, status, case when status='ok' then cop end as price_cop,
        case when status='ok' and l_discount>0.05 then cop*2 end as list_price_cop,
        case when status='ok' then upper(left(p_name,1))||substr(p_name,2) end as name, case when status='ok' then p_brand end as brand,
        case when status='ok' then l_linestatus='O' and l_quantity>25 end as is_available,
        case when status='ok' and p_type<>'STANDARD' then p_type end as source_bucket
        from (select *, case when l_returnflag='R' and l_linestatus='O' then 'failed' when l_discount=0 then 'skipped'
          when l_tax=0.08 then 'failed' when cop*2>50000000 then 'failed' else 'ok' end as status from raw)""",
        RAW,
    ),
)
def normalize_vtex(spark, sf):
    lines = v.read_spread(spark, sf, "lineitem", *LINE).join(v.read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    offer = F.struct(
        price.alias("Price"),
        F.when(F.col("l_discount") > 0.05, F.floor(price + 0.5).cast("double") * 2).otherwise(price).alias("ListPrice"),
        (F.col("l_linestatus") == "O").alias("IsAvailable"),
        (F.col("l_quantity") - 25).cast("bigint").alias("AvailableQuantity"),
    )
    item = F.struct(
        F.lit("77025110").alias("ean"),
        F.concat("p_name", F.lit(" (500 gr)")).alias("nameComplete"),
        F.array(F.struct(F.lit("https://example.org/i.png").alias("imageUrl"))).alias("images"),
        F.array(F.struct(offer.alias("commertialOffer"))).alias("sellers"),
    )
    no_items = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    raw = lines.select(
        F.lit("shop").alias("store"), F.col("p_type").alias("aisle_id"), F.col("l_orderkey").alias("page_no"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("pos"),
        F.when(F.col("l_tax") == 0.08, " ").otherwise(F.col("l_partkey").cast("string")).alias("productId"),
        F.lit(None).cast("string").alias("productName"), F.upper("p_brand").alias("brand"),
        F.when(~no_items, F.array(item)).alias("items"), "l_partkey",
    )
    aisles = v.read(spark, sf, "part").where("p_type <> 'STANDARD'").groupBy("p_type").agg(F.min("p_size").alias("aisle_ord")).select(
        F.lit("shop").alias("store"), F.col("p_type").alias("aisle_id"), F.col("p_type").alias("bucket"), "aisle_ord"
    )
    keyed = nz.normalize_vtex(raw.withColumn("pos", F.struct("pos", "l_partkey")), aisles)
    return keyed.select(
        F.col("page_no").alias("l_orderkey"), F.floor(F.col("pos.pos") / 1_000_000).cast("int").alias("l_linenumber"),
        (F.col("pos.pos") % 1_000_000).alias("l_suppkey"), F.col("pos.l_partkey").alias("l_partkey"), "status", "price_cop",
        "list_price_cop", "name", "brand", "is_available", "source_bucket",
    ).withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("price_cop", "list_price_cop", "name", "brand", "is_available", "source_bucket")})


@query(
    "normalize_shopify",
    with_ctes(
        """select l_orderkey, l_linenumber, l_suppkey, l_partkey, status, case when status='ok' then l_quantity::integer end as price_cop,
        case when status='ok' then bucket end as source_bucket from (select *, case when l_tax=0.08 then 'failed'
          when l_discount=0 then 'skipped' when p_type='PROMO' then 'skipped' when bucket is null then 'skipped' else 'ok' end as status
        from (select *, case when p_type='ECONOMY' then 'viveres' when p_type='LARGE' then 'bebidas'
          when p_type<>'PROMO' and p_name like '%ring' then 'otros' end as bucket from raw))""",
        RAW,
    ),
)
def normalize_shopify(spark, sf):
    lines = v.read_spread(spark, sf, "lineitem", *LINE).join(v.read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = (
        F.when(F.col("l_tax") == 0.08, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".290")))
        .when(F.col("l_discount") == 0, "0.00").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".00")))
    )
    variant = F.struct(price.alias("price"), F.lit(None).cast("string").alias("compare_at_price"), F.lit(True).alias("available"), F.lit("x").alias("barcode"))
    tags = F.when(F.col("p_type") == "LARGE", F.to_json(F.array(F.lit("Nuevo"), F.col("p_type")))).otherwise(F.concat_ws(", ", "p_brand", "p_type"))
    raw = lines.select(
        F.lit("shop").alias("store"), F.col("l_orderkey").alias("page_no"),
        F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("pos"), F.col("l_partkey").cast("string").alias("id"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("vendor"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("product_type"), tags.alias("tags"),
        F.array(variant).alias("variants"), F.array(F.struct(F.lit("https://example.org/i.png").alias("src"))).alias("images"),
    )
    out = nz.normalize_shopify(raw, [("Economy", "viveres"), ("PROMO", None), ("large", "bebidas")], [("Ring", "otros")])
    ok = F.col("status") == "ok"
    return out.select(
        F.col("page_no").alias("l_orderkey"), "pos.l_linenumber", "pos.l_suppkey", "pos.l_partkey", "status",
        F.when(ok, F.col("price_cop")).alias("price_cop"), F.when(ok, F.col("source_bucket")).alias("source_bucket"),
    )


# --- gates and constraints ----------------------------------------------------------------------------------------

GATE = """gate as (select user_id as store, count(*) as seen, count(*) filter (event_type not in ('error','view')) as normalised,
  count(*) filter (event_type='view') as skipped, count(*) filter (event_type='error') as failed from events group by 1)"""


def _staging(spark, sf):
    kind = F.col("event_type")
    return v.read(spark, sf, "events").select(
        F.col("user_id").alias("store"), F.when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("ok").alias("status"),
        kind.alias("reason"), "event_id", "value", F.col("event_id").cast("string").alias("external_id"),
    )


@query(
    "quality_gate",
    with_ctes(
        """select *, failed::double/seen::double as unreadable_share, seen>=50 and failed::double/seen::double>0.2 as aborted from gate""", GATE
    ),
)
def quality_gate(spark, sf):
    return q.unreadable_gate(_staging(spark, sf))


@query(
    "run_report",
    with_ctes(
        """select gate.*, failed::double/seen::double as unreadable_share, seen>=50 and failed::double/seen::double>0.2 as aborted,
        coalesce(u,0) as products_upserted, coalesce(c,0) as prices_changed, coalesce(j,0) as price_jumps_rejected,
        coalesce(d,0) as pages_dropped, coalesce(e,0) as errors, coalesce(r,0) as retired, r is null or r=0 as not_retired,
        up as unpriced_before, ua as unpriced_after,
        not (seen>=50 and failed::double/seen::double>0.2) and coalesce(e,0)=0 and coalesce(d,0)=0 as run_ok
        from gate left join (select user_id, count(*) filter (event_type in ('purchase','click','signup')) u,
          count(*) filter (event_type in ('purchase','click')) c, count(*) filter (event_type='signup') j,
          nullif(count(*) filter (event_type='error' and value>100),0) d, nullif(count(*) filter (event_type='view' and value>150),0) e,
          nullif(count(*) filter (event_type='click' and value>200),0) r, nullif(count(*) filter (value>50),0) up,
          nullif(count(*) filter (value>50),0) ua from events group by 1) on user_id=store""",
        GATE,
    ),
)
def run_report(spark, sf):
    rows = _staging(spark, sf)
    decision = F.when(F.col("reason") == "purchase", "new").when(F.col("reason") == "click", "changed").otherwise("jump")
    diff = rows.where("status = 'ok'").select("store", decision.alias("decision"))
    log = rows.select("store", F.when((F.col("status") == "failed") & (F.col("value") > 100), "dropped").otherwise("ok").alias("outcome"))
    count = lambda name: F.count(F.lit(1)).alias(name)
    errors = rows.where("status = 'skipped' and value > 150").groupBy("store").agg(count("errors"))
    retired = rows.where("reason = 'click' and value > 200").groupBy("store").agg(count("retired"))
    unpriced = rows.where("value > 50").groupBy("store").agg(count("unpriced_before"), count("unpriced_after"))
    return q.run_report(q.unreadable_gate(rows), diff, log, retired, unpriced, errors).withColumn("not_retired", F.col("retired") == 0)


@query(
    "branch_report",
    """with g as (select user_id as store, count(*) as seen, count(*) filter (event_type='error') as failed from events group by 1)
       select store, seen, failed, coalesce(failed::double/seen::double,0)>0.2 as aborted,
       coalesce((select count(*)-count(distinct round(value)) from events e where e.user_id=store and event_type not in ('error','view')),0) as duplicates,
       coalesce((select count(*) from events e where e.user_id=store and event_type='view'),0) as views,
       coalesce((select count(distinct event_type) from events e where e.user_id=store and value>300),0) as saturated,
       coalesce((select count(*) from events e where e.user_id=store and event_type='error' and value>100),0) as requests_dropped from g""",
)
def branch_report(spark, sf):
    rows = _staging(spark, sf).withColumn("external_id", F.round("value").cast("string"))
    stores = rows.select(F.col("store").alias("slug")).distinct()
    log = rows.select("store", F.when((F.col("status") == "failed") & (F.col("value") > 100), "dropped").otherwise("ok").alias("outcome"))
    saturated = rows.where("value > 300").select("store", F.col("reason").alias("point"))
    report = q.branch_run_report(rows, q.branch_gate(rows, stores), log, saturated)
    return report.select(
        "store", "seen", "failed", "aborted", "duplicates",
        F.coalesce(F.try_element_at("skip_reasons", F.lit("view")), F.lit(0).cast("bigint")).alias("views"),
        F.coalesce(F.size("saturated_points"), F.lit(0)).alias("saturated"), "requests_dropped",
    ).withColumn("saturated", F.greatest("saturated", F.lit(0)))


@query(
    "retirement_gate",
    """with f as (select c_custkey as store, c_mktsegment='BUILDING' as dry_run, c_mktsegment='MACHINERY' as aborted, c_acctbal<0 as partial,
         count(o_orderkey) filter (o_orderpriority='1-URGENT' and o_totalprice>400000) as pages_dropped, count(o_orderkey) as found,
         count(o_orderkey) filter (o_orderstatus='P') as missing from customer left join orders on o_custkey=c_custkey group by 1,2,3,4)
       select *, case when dry_run then 'dry run' when aborted then 'run aborted' when partial then 'partial run'
         when pages_dropped>0 then pages_dropped||' requests dropped' when missing>found*0.25 then missing||' missing of '||found end as retire_skip from f""",
)
def retirement_gate(spark, sf):
    orders = v.read(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)).alias("pages_dropped"),
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("o_orderstatus") == "P").alias("missing"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    facts = v.read(spark, sf, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("store"), (F.col("c_mktsegment") == "BUILDING").alias("dry_run"),
        (F.col("c_mktsegment") == "MACHINERY").alias("aborted"), (F.col("c_acctbal") < 0).alias("partial"),
        zero("pages_dropped"), zero("found"), zero("missing"),
    )
    return q.retirement_gate(facts)


@query(
    "constraint_violations",
    """select 'price_snapshot' as table_name, c as "constraint", k as key from (
         select l_orderkey||'|'||l_linenumber||'|'||l_partkey as k, unnest([case when round(l_extendedprice/l_quantity)<=1000 then 'price_over_1000' end,
           case when l_discount>=0.1 then 'discount' end]) as c from lineitem) where c is not null
       union all select 'lineitem', 'unique', l_orderkey||'|'||l_linenumber from lineitem group by l_orderkey, l_linenumber having count(*)>1
       union all select 'orders', 'reference_o_custkey', o_custkey::varchar from (select distinct o_custkey from orders
         where not exists (select 1 from customer where c_custkey=o_custkey and c_mktsegment<>'BUILDING'))""",
)
def constraint_violations(spark, sf):
    lines = v.read(spark, sf, "lineitem")
    checks = {
        "price_over_1000": F.round(F.col("l_extendedprice") / F.col("l_quantity")) > 1000, "discount": F.col("l_discount") < 0.1,
    }
    rows = q.check_constraints(lines, "price_snapshot", ["l_orderkey", "l_linenumber", "l_partkey"], checks)
    unique = q.check_unique(lines, "lineitem", ["l_orderkey", "l_linenumber"])
    parents = v.read(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    return rows.unionByName(unique).unionByName(q.check_reference(v.read(spark, sf, "orders"), "orders", "o_custkey", parents, "c_custkey"))


@query(
    "table_checks",
    """with c as (select unnest([{'t': 'store', 'c': case when trim(c_name)='' then 'slug_filled' end}, {'t': 'store', 'c': case when c_mktsegment='BUILDING' then 'source_type' end},
          {'t': 'store_product', 'c': case when c_custkey%3=0 then 'ean_digits' end}, {'t': 'store_product', 'c': case when c_mktsegment='HOUSEHOLD' then 'name_filled' end},
          {'t': 'store_product', 'c': case when c_nationkey=3 then 'unit_kind' end}, {'t': 'store_product', 'c': case when c_nationkey=4 then 'unit_measure' end},
          {'t': 'store_product', 'c': case when c_acctbal<=0 then 'unit_value_positive' end}, {'t': 'store_product', 'c': case when c_nationkey=5 then 'unit_pair' end},
          {'t': 'price_snapshot', 'c': case when c_acctbal<1 then 'price_positive' end}, {'t': 'price_snapshot', 'c': case when c_custkey%5=0 then 'list_price_positive' end},
          {'t': 'shopping_list', 'c': case when c_mktsegment='HOUSEHOLD' then 'name_filled' end},
          {'t': 'list_item', 'c': case when c_acctbal<=0 then 'quantity_positive' end}, {'t': 'list_item', 'c': case when c_custkey%7=0 then 'price_present' end},
          {'t': 'list_reminder', 'c': case when c_nationkey=6 then 'frequency' end},
          {'t': 'list_reminder', 'c': case when not (case when c_nationkey%2=0 and c_nationkey<>6 then c_custkey%2=0 else c_custkey%2=1 end) then 'shape' end},
          {'t': 'list_reminder', 'c': case when c_nationkey%2=1 and c_custkey%4=0 then 'anchor' end},
          {'t': 'store_branch', 'c': case when c_mktsegment='HOUSEHOLD' then 'name_filled' end}, {'t': 'store_branch', 'c': case when c_nationkey=20 then 'in_country' end},
          {'t': 'store_branch', 'c': case when c_mktsegment='BUILDING' then 'source' end}]) as x, c_custkey from customer)
       select x.t as table_name, x.c as "constraint", c_custkey::varchar as key from c where x.c is not null""",
)
def table_checks(spark, sf):
    """Every table's own checks over customers, whose fields break one or the other."""
    key, nation, balance = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    segment = F.col("c_mktsegment")
    name, whole = F.when(segment == "HOUSEHOLD", " ").otherwise(segment), F.floor(balance).cast("int")
    monthly = (nation % 2 == 0) & (nation != 6)
    wide = v.read(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("slug"), F.when(segment == "BUILDING", "guess").otherwise("api").alias("source_type"),
        F.when(key % 3 == 0, "77-1").when(key % 3 == 1, "7701234567890").alias("ean"), name.alias("name"),
        F.when(nation == 3, "length").otherwise("weight").alias("unit_kind"), F.when(nation == 4, "mile").when(nation != 5, "g").alias("unit_measure"),
        balance.alias("unit_value"), whole.alias("price_cop"), F.when(key % 5 == 0, 0).when(key % 5 == 1, 7).alias("list_price_cop"), balance.alias("quantity"),
        F.when(key % 7 != 0, 1).alias("price_cop_at_add"),
        F.when(nation == 6, "daily").when(monthly, "monthly").otherwise("biweekly").alias("frequency"),
        F.when(key % 2 == 0, 31).alias("day_of_month"), F.when(key % 2 == 1, 7).alias("weekday"), F.when(key % 4 != 0, "2026-01-01").alias("anchor_date"),
        F.lit(4.6).alias("latitude"), F.when(nation == 20, 2.3).otherwise(-74.0).alias("longitude"), F.when(segment == "BUILDING", "guess").otherwise("osm").alias("source"),
    )
    out = None
    for table in ("store", "store_product", "price_snapshot", "shopping_list", "list_item", "list_reminder", "store_branch"):
        part = q.check_constraints(wide, table, ["c_custkey"])
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "write_split",
    """select l_orderkey, l_linenumber, l_partkey, case when l_tax<=0.07 and l_quantity>=2 then '' else
       concat_ws(',', case when l_tax>0.07 then 'tax' end, case when l_quantity<2 then 'quantity' end) end as failed_checks from lineitem""",
)
def write_split(spark, sf):
    checks = {"tax": F.col("l_tax") <= 0.07, "quantity": F.col("l_quantity") >= 2}
    good, bad = q.split_valid(v.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_quantity"), checks)
    both = good.withColumn("failed_checks", F.lit("")).unionByName(bad.withColumn("failed_checks", F.array_join("failed_checks", ",")))
    return both.drop("l_tax", "l_quantity")


# --- catalogue upkeep ---------------------------------------------------------------------------------------------


def _catalog(spark, sf):
    return v.products(spark, sf).select(
        F.col("store_id").alias("store_slug"), "external_id", F.col("id").cast("string").alias("id"), "ean", "name", "brand", "category_id",
        F.col("category_id").alias("source_bucket"), "unit_kind", "unit_value", "unit_measure", F.lit(None).cast("string").alias("image_url"),
        "is_available", "first_seen_at", "last_seen_at",
    )


ID = """lower(substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12))"""


@query(
    "upsert_catalog",
    f"""with old as (select p_brand, p_partkey, p_name, p_type, p_size from part where p_size<=30),
       new as (select p_brand, p_partkey, 'new '||p_name as p_name, p_type, p_size from part where p_size>=20),
       j as (select coalesce(n.p_brand,o.p_brand) as b, coalesce(n.p_partkey,o.p_partkey) as k, o.p_partkey as ok, n.p_partkey as nk,
         coalesce(n.p_name,o.p_name) as nm, coalesce(n.p_type,o.p_type) as ty, o.p_type as ot, n.p_type as nt,
         md5('["'||coalesce(n.p_brand,o.p_brand)||'","'||coalesce(n.p_partkey,o.p_partkey)||'"]') as h
         from old o full join new n on o.p_partkey=n.p_partkey and o.p_brand=n.p_brand)
       select b as store_slug, k::varchar as external_id, case when ok is not null then ok::varchar else {ID} end as id, nm as name,
         case when nk is not null then case when ty<>'PROMO' then ty end else ot end as category_id, nk is not null as seen_now,
         ok is null as first_now from j""",
)
def upsert_catalog(spark, sf):
    now = F.lit("2002-01-01 00:00:00").cast("timestamp")
    all_rows = _catalog(spark, sf).join(v.read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_size"), "id")
    staging = all_rows.where("p_size >= 20").withColumns({"name": F.concat(F.lit("new "), "name"), "category_slug": F.col("category_id")})
    staging = staging.withColumnRenamed("store_slug", "store").drop("category_id")
    aisles = v.categories(spark, sf).where("slug <> 'PROMO'")
    merged = cat.upsert_catalog(all_rows.where("p_size <= 30").drop("p_size"), staging, aisles, now)
    return merged.select(
        "store_slug", "external_id", "id", "name", "category_id", (F.col("last_seen_at") == now).alias("seen_now"),
        (F.col("first_seen_at") == now).alias("first_now"),
    ).withColumn("seen_now", F.coalesce("seen_now", F.lit(False))).withColumn("first_now", F.coalesce("first_now", F.lit(False)))


@query(
    "retire_stale",
    """with p as (select p_partkey, p_brand, p_size<=45 as av, max(l_shipdate) as seen from part left join lineitem on l_partkey=p_partkey group by 1,2,3),
       g as (select p_brand, count(*) filter (av and seen < timestamp '2001-10-01' - interval 3 days) as missing, count(*) as found from p group by 1)
       select p_partkey::varchar as id, av and not (coalesce(seen < timestamp '2001-10-01' - interval 3 days, false) and missing<=found*0.25) as is_available
       from p join g using (p_brand)""",
)
def retire_stale(spark, sf):
    at = F.lit("2001-10-01 00:00:00").cast("timestamp")
    catalog = _catalog(spark, sf)
    found = catalog.groupBy(F.col("store_slug").alias("store")).agg(F.count(F.lit(1)).alias("found"))
    no = F.lit(False)
    facts = cat.retirement_facts(catalog, at).join(found, "store").withColumns(
        {"dry_run": no, "aborted": no, "partial": no, "pages_dropped": F.lit(0)}
    )
    return cat.retire_products(catalog, q.retirement_gate(facts), at).select("id", "is_available")


@query(
    "unpriced_count",
    """select p_brand as store, count(*) as unpriced from part where not exists (select 1 from lineitem
       where l_partkey=p_partkey and l_returnflag='R' and l_quantity>40) group by 1""",
)
def unpriced_count(spark, sf):
    priced = v.read(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(
        F.col("l_partkey").cast("string").alias("store_product_id")
    )
    return cat.unpriced_count(_catalog(spark, sf), priced)
