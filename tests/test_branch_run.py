"""Landed shop pages to a settled sweep, with every reader."""

import json

from pyspark.sql import functions as F

from larder import schemas
from larder.operators import branches as br
from larder.plans.branch_run import locate_isimo, settle_branches
from larder.sources import readers


def put(path, body):
    path.mkdir(parents=True, exist_ok=True)
    (path / "p.json").write_text(json.dumps(body))
    return str(path)


def point(pid, name, lat=4.65):
    return {"distance": 1.0, "pickupPoint": {"id": pid, "friendlyName": name, "isActive": True,
            "address": {"street": "Cl 1", "city": "Bogotá, D.C.", "geoCoordinates": [-74.05, lat]}}}


def test_sweep(spark, tmp_path):
    pickup = tmp_path / "pickup"
    items = [point(str(i), f"BOG TIENDA {i}") for i in range(8)] + [point("3", "BOG OTRA"), point("x", "BOG MADRID", 40.4)]
    put(pickup / "store=d1" / "point=A" / "page_no=1", {"paging": {"page": 1, "pageSize": 50, "total": 300, "pages": 1}, "items": items})
    put(pickup / "store=d1" / "point=B" / "page_no=1", {"paging": {"page": 1, "pageSize": 50, "total": 0, "pages": 0}, "items": None})
    raw, log, holes = readers.read_pickup_pages(spark, str(pickup))
    assert holes.count() == 0
    ara = readers.read_locator(spark, put(tmp_path / "ara", [{"store_code": "A1", "name": "ARA - Cali", "latitude": "3.4", "longitude": "-76.5", "status": "1", "city": "CALI", "address": ""}]), "ara")
    dollar = readers.read_locator(spark, put(tmp_path / "dollar", {"StoreLocations": [
        {"LocationId": "L1", "Name": "X", "Address": " Cl 3 ", "Location": {"type": "Point", "coordinates": [-74.1, 4.6]},
         "ExtraData": {"BusinessStatus": 0, "Name": {"LongName": "Dollarcity Centro"}, "Address": {"Locality": "BOGOTA D.C.", "CountryCode": "CO"}}},
        {"LocationId": "L2", "Location": {"type": "Point", "coordinates": [-74.1, 4.6]}, "ExtraData": {"BusinessStatus": 1}}]}), "dollarcity")
    curated = readers.read_curated(spark, str((lambda p: (put(p / "store=supermu", {"source": "s", "verifiedAt": "2026-10-01", "coordinates": "c", "branches": [
        {"externalId": "1", "name": "Uno", "address": None, "city": None, "latitude": 6.2, "longitude": -75.5}]}), p)[1])(tmp_path / "curated")))
    wp = readers.read_wp_shops(
        spark,
        put(tmp_path / "wp", [{"id": 5, "title": {"rendered": "ISIMO Centro &#8211; 1"}, "content": {"rendered": "<p>Cra 80 # 50-87</p>"}, "tiendas-municipios": [7], "tiendas-departamento": [9]},
                              {"id": 6, "title": {"rendered": "X"}, "content": {"rendered": "Mall"}, "tiendas-municipios": [7], "tiendas-departamento": []}]),
        put(tmp_path / "towns", [{"id": 7, "name": "MEDELL&#205;N"}]), put(tmp_path / "departments", [{"id": 9, "name": "Antioquia"}]))
    hit = (6.25, -75.6, 30, "shop", "t", None, {"road": "Carrera 80", "house_number": "50-87", "city": "Medellín", "state": "Antioquia"}, [6.2, 6.3, -75.6, -75.5])
    answers = spark.createDataFrame([("Carrera 80 50-87, Medellin, Antioquia", "every", 1, [hit])], f"query string, shape string, raw_count int, hits array<{schemas.OSM_HIT}>").withColumn(
        "fetched_at", F.lit("2026-09-01").cast("timestamp"))
    located, tally = locate_isimo(wp, answers, F.lit("2026-10-01").cast("timestamp"))
    assert {r.outcome: r.shops for r in tally.collect()} == {"address": 1, "address without a street": 1}

    staged = br.normalize_branches({"d1": raw, "ara": ara, "dollarcity": dollar, "supermu": curated, "isimo": located})
    stores = spark.createDataFrame([(s,) for s in ("d1", "ara", "dollarcity", "supermu", "isimo", "jumbo")], "slug string")
    log_rows = spark.createDataFrame([("u", "ara", "dropped", "x")], schemas.FETCH_LOG)
    at = F.lit("2026-10-02 00:00:00").cast("timestamp")
    old = spark.createDataFrame([("d1", "gone"), ("ara", "gone"), ("jumbo", "gone")], "store_slug string, external_id string").select(
        "store_slug", "external_id", F.lit("id").alias("id"), F.lit("old").alias("name"), F.lit("").alias("address"), F.lit("").alias("city"), F.lit(4.0).alias("latitude"),
        F.lit(-74.0).alias("longitude"), F.lit("official").alias("source"), F.lit(True).alias("is_active"), F.lit("2026-09-01").cast("timestamp").alias("last_seen_at"),
        F.lit("2026-09-01").cast("timestamp").alias("created_at"))
    run = settle_branches(staged, old, stores, log_rows, br.saturated_points(log), at)
    shops = {(r.store_slug, r.external_id): r for r in run.branches.collect()}
    assert len(shops) == 8 + 1 + 1 + 1 + 1 + 3
    assert not shops["d1", "gone"].is_active and shops["ara", "gone"].is_active and shops["jumbo", "gone"].is_active
    assert shops["isimo", "5"].name == "Ísimo Centro – 1" and shops["isimo", "5"].city == "Medellín"
    assert shops["dollarcity", "L1"].city == "Bogota" and shops["d1", "3"].name == "D1 Tienda 3"
    report = {r.store: r for r in run.report.collect()}
    assert (report["d1"].seen, report["d1"].duplicates, report["d1"].skip_reasons, report["d1"].saturated_points) == (10, 1, {"outside the country": 1}, ["A"])
    assert report["d1"].retired == 1 and report["ara"].retire_skip == "1 requests dropped" and report["jumbo"].aborted and report["jumbo"].retire_skip == "run aborted"
