"""Landed pages to a settled run: readers, normalisers, gates, upsert, diff, publish, retire, and idempotence."""

import json

import pytest
from pyspark.sql import functions as F

from larder import schemas
from larder.operators import catalog as cat
from larder.operators import prices as pr
from larder.operators.normalize import dedupe_first, normalize_shopify, truncated_aisles
from larder.plans.price_run import settle, stage_vtex
from larder.sources import readers, sinks



def day1():
    return F.lit("2026-10-01 06:00:00").cast("timestamp")


def day2():
    return F.lit("2026-10-08 06:00:00").cast("timestamp")


def product(pid, name, price, brand="DIANA", ean=None, listed=None, available=True, quantity=5, **more):
    offer = {"Price": price, "ListPrice": listed or price, "IsAvailable": available, "AvailableQuantity": quantity}
    item = {"ean": ean, "nameComplete": name, "images": [{"imageUrl": "https://x.test/i.png"}], "sellers": [{"commertialOffer": offer}]}
    return {"productId": pid, "productName": name, "brand": brand, "items": [item], **more}


def land(folder, store, aisle, page, records):
    path = folder / f"store={store}" / f"aisle_id={aisle.replace('/', '%2F')}" / f"page_no={page}"
    path.mkdir(parents=True)
    (path / "page.json").write_text(records if isinstance(records, str) else json.dumps(records))


@pytest.fixture()
def aisles(spark):
    return spark.createDataFrame(
        [("exito", "10/1", "Despensa", "viveres", 0), ("exito", "020", "Lácteos", "lacteos", 1)],
        "store string, aisle_id string, label string, bucket string, aisle_ord int",
    )


@pytest.fixture()
def categories(spark):
    return spark.createDataFrame([(s, s) for s in ("arroz", "leche", "otros", "galletas")], "id string, slug string")


def run(spark, folder, aisles, categories, catalog, current, at):
    raw, log, holes = readers.read_vtex_pages(spark, str(folder))
    fetch = holes.unionByName(truncated_aisles(log, aisles))
    return settle(stage_vtex(raw, aisles, {"d1": "productName"}), catalog, current, categories, fetch, "NACIONAL", at)


def empty(spark):
    return spark.createDataFrame([], schemas.CATALOG), spark.createDataFrame([], schemas.CURRENT)


def test_run_upserts_prices_and_repeats_nothing(spark, tmp_path, aisles, categories):
    land(tmp_path, "exito", "10/1", 1, [
        product("1", "Lenteja DIANA x 500g", 4200.4, ean="7702511000014", listed=5000),
        product(2, "Leche entera (900 ml)", 3900, brand="Sin marca", quantity=0),
        product("3", "Galleta leche", 0),
        {"productId": "4", "items": []},
        product(" ", "Arroz sin id", 100),
        product("9", "Arroz carisimo", 3_450_034_500),
    ])
    land(tmp_path, "exito", "020", 1, [product("2", "Leche otra", 9999), product("5", "Leche deslactosada 1,1 L", 4100)])
    catalog, current = empty(spark)
    first = run(spark, tmp_path, aisles, categories, catalog, current, day1())
    rows = {r.external_id: r for r in first.catalog.collect()}
    assert set(rows) == {"1", "2", "5"}
    assert rows["1"].name == "Lenteja x 500g" and rows["1"].brand == "Diana" and rows["1"].ean == "7702511000014"
    assert (rows["1"].unit_measure, int(rows["1"].unit_value)) == ("g", 500)
    assert rows["2"].source_bucket == "viveres" and rows["2"].brand is None and not rows["2"].is_available
    assert rows["5"].category_id == "leche"
    report = first.report.collect()[0]
    assert (report.seen, report.normalised, report.skipped, report.failed) == (7, 3, 1, 3)
    assert (report.prices_changed, report.unpriced_before, report.unpriced_after) == (3, None, None)
    assert report.run_ok and report.retire_skip is None
    prices = {r.price_cop: r.list_price_cop for r in first.snapshots.collect()}
    assert prices == {4200: 5000, 3900: None, 4100: None}

    again = run(spark, tmp_path, aisles, categories, first.catalog, first.current, day1())
    assert again.snapshots.count() == 0
    assert sorted(r.id for r in again.catalog.collect()) == sorted(r.id for r in first.catalog.collect())


def test_jump_is_refused_but_the_product_is_kept(spark, tmp_path, aisles, categories):
    land(tmp_path, "exito", "10/1", 1, [product("1", "Arroz", 42000), product("2", "Leche", 4500)])
    catalog, current = empty(spark)
    ids = {e: F.lit(e) for e in ("1", "2")}
    known = spark.createDataFrame([("1", 4200), ("2", 4200)], "external_id string, price_cop int").select(
        cat.stable_id(F.lit("exito"), F.col("external_id")).alias("store_product_id"), F.lit("NACIONAL").alias("region_code"),
        "price_cop", F.lit(None).cast("int").alias("list_price_cop"), day1().alias("captured_at"),
    )
    assert ids
    result = run(spark, tmp_path, aisles, categories, catalog, known, day2())
    assert [r.price_cop for r in result.snapshots.collect()] == [4500]
    assert [(r.previous_cop, r.price_cop) for r in result.jumps.collect()] == [(4200, 42000)]
    assert result.catalog.count() == 2
    assert sorted(r.price_cop for r in result.current.collect()) == [4200, 4500]


def test_holes_truncation_and_stale_products(spark, tmp_path, aisles, categories):
    land(tmp_path, "exito", "10/1", 1, [product(str(i), f"Arroz {i}", 1000 + i) for i in range(4)])
    catalog, current = empty(spark)
    first = run(spark, tmp_path, aisles, categories, catalog, current, day1())
    later = tmp_path / "later"
    land(later, "exito", "10/1", 1, [product(str(i), f"Arroz {i}", 1000 + i) for i in range(1, 4)])
    gone = run(spark, later, aisles, categories, first.catalog, first.current, day2())
    report = gone.report.collect()[0]
    # one missing of three found is more than a quarter
    assert report.retire_skip == "1 missing of 3" and report.retired == 0

    land(later, "exito", "020", 1, [product(str(i), f"Leche {i}", 1000 + i) for i in range(10, 20)])
    gone = run(spark, later, aisles, categories, first.catalog, first.current, day2())
    assert gone.report.collect()[0].retired == 1
    assert [r.external_id for r in gone.catalog.where("not is_available").collect()] == ["0"]

    land(later, "exito", "020", 2, "not json")
    holed = run(spark, later, aisles, categories, first.catalog, first.current, day2())
    report = holed.report.collect()[0]
    assert report.pages_dropped == 1 and not report.run_ok and report.retire_skip == "1 requests dropped"

    log = spark.createDataFrame(
        [("u", "exito", "10/1", 49, 50), ("v", "exito", "10/1", 50, 50), ("w", "exito", "020", 50, 49)],
        "url string, store string, aisle_id string, page_no int, records int",
    )
    cut = truncated_aisles(log, aisles).collect()
    assert [(r.url, r.outcome) for r in cut] == [("v", "dropped")] and "Despensa" in cut[0].reason


def test_unreadable_share_aborts_only_its_store(spark, tmp_path, aisles, categories):
    land(tmp_path, "exito", "10/1", 1, [product(str(i), f"Arroz {i}", 1000) for i in range(39)] + [{"productId": "x"}] * 1)
    land(tmp_path, "exito", "020", 1, [{"productId": f"b{i}", "items": []} for i in range(12)])
    land(tmp_path, "d1", "10/1", 1, [product("1", "Arroz", 1000), {"productId": "2"}, {"productId": "3"}])
    catalog, current = empty(spark)
    result = run(spark, tmp_path, aisles, categories, catalog, current, day1())
    report = {r.store: r for r in result.report.collect()}
    assert report["exito"].aborted and report["exito"].prices_changed == 0 and report["exito"].retire_skip == "run aborted"
    assert not report["d1"].aborted and report["d1"].prices_changed == 1
    assert [r.store_slug for r in result.catalog.collect()] == ["d1"]


def test_dedupe_keeps_the_first_and_every_row_without_a_key(spark):
    rows = spark.createDataFrame([("A", 1), ("B", 2), (" A ", 3), (None, 4), (None, 5)], "k string, at int")
    assert sorted(r["at"] for r in dedupe_first(rows, ["k"], ["at"]).collect()) == [1, 2, 4, 5]


TAGS = [("MASCOTAS", "mascotas"), ("LICORES Y CIGARRILLOS", None), ("PANADERIA", "panaderia"), ("ABARROTES", "viveres")]
TYPES = [("GASEOSA", "bebidas"), ("LICORES", None)]


def test_shopify_statuses(spark, tmp_path):
    def item(pid, title, price, tags, kind="", **variant):
        return {"id": pid, "title": title, "vendor": "ZENU", "product_type": kind, "tags": tags,
                "variants": [{"price": price, "available": True, **variant}], "images": [{"src": "https://x.test/a.png"}]}

    page = {"products": [
        item(1, "GALLETA MERIENDA 170G TENTACION", "8290.00", ["Promo", "abarrotes"], compare_at_price="9000.00", barcode=" 77025110 "),
        item(2, "X", "8.290", ["ABARROTES"]), item(3, "X", "82.50", ["ABARROTES"]), item(4, "X", "0", ["ABARROTES"]),
        item(5, "RON 750M", "40000", ["Licores y Cigarrillos", "ABARROTES"]), item(6, "COLA 400ML", "2000", "Nuevo, Otro", "gaseosa"),
        item(7, "COSA", "2000", []), item(8, "COSA", "2000", {"a": 1}), {"id": 9, "title": "COSA", "variants": []},
    ]}
    path = tmp_path / "store=supermu" / "page_no=1"
    path.mkdir(parents=True)
    (path / "p.json").write_text(json.dumps(page))
    (tmp_path / "store=supermu" / "page_no=2").mkdir()
    (tmp_path / "store=supermu" / "page_no=2" / "p.json").write_text("[]")
    raw, holes = readers.read_shopify_pages(spark, str(tmp_path))
    assert holes.count() == 1
    got = {r.pos + 1: r for r in normalize_shopify(raw, TAGS, TYPES).collect()}
    assert [(k, got[k].status) for k in sorted(got)] == [
        (1, "ok"), (2, "failed"), (3, "failed"), (4, "skipped"), (5, "skipped"), (6, "ok"), (7, "skipped"), (8, "failed"), (9, "failed"),
    ]
    assert got[1].name == "Galleta merienda tentacion" and got[1].price_cop == 8290 and got[1].list_price_cop == 9000
    assert got[1].ean == "77025110" and got[1].source_bucket == "viveres" and got[1].category_slug == "galletas"
    assert got[5].reason == "out of scope" and got[7].reason == "no aisle in the source" and got[6].source_bucket == "bebidas"


def test_sinks_replace_only_touched_folders_and_repeat_runs(spark, tmp_path):
    rows = lambda store, n: spark.range(n).select(
        F.lit(store).alias("store_slug"), F.col("id").cast("string").alias("external_id"), F.lit("c").alias("category_id"))
    path = str(tmp_path / "catalog")
    sinks.write_catalog(rows("a", 5).unionByName(rows("b", 3)), path, 2)
    sinks.write_catalog(rows("a", 2), path, 2)
    got = {r.store_slug: r["count"] for r in spark.read.parquet(path).groupBy("store_slug").count().collect()}
    assert got == {"a": 2, "b": 3}
    snaps = spark.range(4).select("id", F.lit("p").alias("store_product_id"), day1().alias("captured_at"))
    for _ in range(2):
        sinks.append_prices(snaps, str(tmp_path / "prices"), "run-1", 2)
    assert spark.read.parquet(str(tmp_path / "prices")).count() == 4
    assert pr.CURRENT[0] == "store_product_id"
