"""Nearest shops against brute force, shops of every source, reminders, addresses, trips."""

import random

import numpy as np
from pyspark.sql import functions as F

from larder.fixed import SPACE
from larder.functions.text import MARKED, PLAIN, fold, squeeze
from larder.operators import branches as br
from larder.operators import geocode as gc
from larder.operators import proximity as px
from larder.operators import reminders as rm
from larder.operators import trips as tr
from larder.plans import place_queries
from larder.schemas import OSM_HIT


def metres(a, b, c, d):
    h = np.sin(np.radians(c - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(d - b) / 2) ** 2
    return 2 * 6371000 * np.arcsin(np.sqrt(h))


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    shops = [(i, i % 7, float(4 + rng.normal() * 0.3), float(-74 + rng.normal() * 0.3), bool(rng.random() > 0.1)) for i in range(600)]
    shops += [(5000 + i, 1, 4.65, -74.05, True) for i in range(300)]
    origins = [(i, float(4 + rng.normal() * 0.5), float(-74 + rng.normal() * 0.5)) for i in range(60)] + [(900, 4.65, -74.05), (901, 9.0, -74.0)]
    b = spark.createDataFrame(shops, "id int, store_id int, latitude double, longitude double, is_active boolean")
    o = spark.createDataFrame(origins, "origin_id int, lat double, lng double")
    for radius, limit in ((25000, 30), (5000, 3), (90000, 1000)):
        want = {}
        for oid, la, ln in origins:
            near = sorted((metres(la, ln, s[2], s[3]), s[0]) for s in shops if s[4])
            ids = [i for d, i in near if d <= min(radius, 50000)][: min(limit, 100)]
            if ids:
                want[oid] = ids
        got = {}
        for r in px.nearest_branches(o, b, radius, limit).orderBy("origin_id", "rank").collect():
            got.setdefault(r.origin_id, []).append(r.id)
        assert got == want
    chains = {(r.origin_id, r.store_id): round(r._metres) for r in px.nearest_chains(o, b, 25000).collect()}
    want = {}
    for oid, la, ln in origins:
        for s in shops:
            d = metres(la, ln, s[2], s[3])
            if s[4] and d <= 25000:
                want[(oid, s[1])] = min(want.get((oid, s[1]), 1e9), d)
    assert chains == {k: round(v) for k, v in want.items()}


def test_sql_functions(spark):
    px.register_functions(spark)
    row = spark.sql("select larder_fold('Piña') f, larder_distance_m(4.6, -74.0, 4.7, -74.0) d, larder_unit_price(4200, 500, 'g') u").first()
    assert (row.f, round(row.d), row.u) == ("pina", 11119, 840)


PICKUP = "store string, pos int, raw struct<id string, friendlyName string, isActive boolean, address struct<street string, city string, geoCoordinates array<double>>>"


def point(pid, name, lng=-74.05, lat=4.65, city="BOGOTÁ D.C.", active=True, street=" Cl 1 "):
    return (pid, name, active, (street, city, [lng, lat] if lng is not None else None))


def test_pickup_sources(spark):
    def run(fn, *raws):
        df = spark.createDataFrame([("s", i, r) for i, r in enumerate(raws)], PICKUP)
        return [(r.status, r.external_id, r.name, r.city) for r in fn(df).orderBy("pos").collect()]

    assert run(br.exito_branches, point("x_ptorecogida_0042", "EXITO COLINA"), point("x_abc", "Exito"), point("x_ptorecogida_1", "Punto Exito"),
               point("x_ptorecogida_1", "Exito", None), point("x_ptorecogida_1", "Exito", 2.0)) == [
        ("ok", "42", "Éxito Colina", "Bogotá D.c."), ("skipped", None, None, None), ("skipped", None, None, None), ("failed", None, None, None), ("skipped", None, None, None)]
    assert run(br.d1_branches, point("77", "BOG CALLE 80", city="Bogotá, D.C.")) == [("ok", "77", "D1 Calle 80", "Bogotá")]
    assert run(br.olimpica_branches, point("olimpicaswl007_007", "007 - MEDELL�N", -75.58, 6.24), point("olimpicaswl1_2", "1 - CALI"),
               point("olimpicaswl1_1", "1 - CALI", -74.0, 4.6), point("olimpicaswl1_1", "1 - CALI", -76.5, 3.4, active=False)) == [
        ("ok", "7", "Olímpica Medellín", "Medellín"), ("skipped", None, None, None), ("skipped", None, None, None), ("skipped", None, None, None)]
    assert run(br.carulla_branches, point("c_ptorecogida12", "Carulla 85", city="Provincia de Cartagena De Indias"), point("c_ptorecogida12", "Otro")) == [
        ("ok", "12", "Carulla 85", "Cartagena"), ("skipped", None, None, None)]
    assert run(br.jumbo_branches, point("j_09", "JM Jumbo Calima"), point("j_09", "Donación")) == [("ok", "9", "Jumbo Calima", "Bogotá"), ("skipped", None, None, None)]


def test_locator_and_curated_sources(spark):
    ara = spark.createDataFrame(
        [("ara", 0, ("A1", "ARA - Cali - CALI Cali Norte", "Cl 2", "3.4", "-76.5", "1", "CALI")), ("ara", 1, ("A2", "x", "", "", "", "1", "")), ("ara", 2, ("A3", "x", "", "3.4", "-76.5", "0", "")),
         ("ara", 3, (None, "x", "", "3.4", "-76.5", "1", ""))],
        "store string, pos int, raw struct<store_code string, name string, address string, latitude string, longitude string, status string, city string>")
    assert [(r.status, r.name) for r in br.ara_branches(ara).orderBy("pos").collect()] == [("ok", "Ara CALI Norte"), ("skipped", None), ("skipped", None), ("failed", None)]
    curated = spark.createDataFrame([("supermu", 0, ("1", "Uno", None, None, 6.2, -75.5)), ("supermu", 1, ("2", "Dos", None, None, 40.4, -3.7))],
        "store string, pos int, raw struct<externalId string, name string, address string, city string, latitude double, longitude double>")
    assert [r.status for r in br.normalize_branches({"supermu": curated}).orderBy("pos").collect()] == ["ok", "failed"]
    assert br.coverage_grid(spark).count() == 62 + sum(
        1 for r, s in ((20, 6), (16, 6), (12, 6), (10, 6)) for i in range(-4, 5) for j in range(-4, 5) if abs(i) <= r // s and abs(j) <= r // s and np.hypot(i, j) * s <= r)


def test_reminders(spark):
    rows = [("l1", "weekly", 6, None, "08:00", None, True), ("l2", "biweekly", 3, None, "18:00", "2026-09-02", True), ("l3", "monthly", None, 31, "12:00", None, True),
            ("l4", "weekly", 1, None, "08:00", None, False), ("l5", "biweekly", 3, None, "18:00", "2027-01-06", True)]
    df = spark.createDataFrame(rows, "list_id string, frequency string, weekday int, day_of_month int, time_local string, anchor_date string, is_enabled boolean")
    got = {}
    for r in rm.expand_occurrences(df, F.lit("2026-10-03 08:00:00"), 2).orderBy("list_id", "due_at").collect():
        got.setdefault(r.list_id, []).append(str(r.due_at)[:16])
    assert got == {"l1": ["2026-10-10 08:00", "2026-10-17 08:00"], "l2": ["2026-10-14 18:00", "2026-10-28 18:00"],
                   "l3": ["2026-10-31 12:00", "2026-11-30 12:00"], "l5": ["2027-01-06 18:00", "2027-01-20 18:00"]}


def hit(road, lat, lon, box, rank=26, house=None, city="Medellín", state="Antioquia", category="highway", **more):
    address = {k: v for k, v in {"road": road, "house_number": house, "city": city, "state": state, **more}.items() if v}
    return (lat, lon, rank, category, "t", road if category == "highway" else None, address, box)


def test_addresses_and_decisions(spark):
    cases = {"Diagonal 12 No 8A – 35": ("Diagonal 12", "Carrera 8A", "35"), "Carrera 9 Bis # 21-14": ("Carrera 9 Bis", "Calle 21", "14"),
             "CARRERA 63 D # 44 B 17 SUR": ("Carrera 63D", "Calle 44B Sur", "17"), "Calle 18 # 6-73 Este": ("Calle 18", "Carrera 6 Este", "73"),
             "Carrera 19 N.128-41 ROSALES": ("Carrera 19", "Calle 128", "41"), "AVENIDA 37N # 112-118": ("Avenida 37N", None, None), "Plaza Norte": (None, None, None)}
    df = spark.createDataFrame([(a,) for a in cases], "address string")
    got = gc.parse_addresses(df).select("address", gc.street_label(F.col("street")).alias("s"), gc.street_label(F.col("cross")).alias("c"), "plate")
    assert {r.address: (r.s, r.c, r.plate) for r in got.collect()} == cases

    shops = [("door", "Cra 80 # 50-87"), ("corner", "Cra 81 # 50-87"), ("long", "Cra 82 # 50-87"), ("away", "Cra 83 # 50-87"), ("none", "Cra 84 # 50-87"), ("short", "Cra 85 # 51-87"), ("far cross", "Cra 86 # 52-1"), ("hamlet", "Cra 87 # 53-1")]
    df = spark.createDataFrame([(s, "Ísimo", f"<p>{a}</p>", "ANTIOQUIA" if s == "door" else "MEDELLÍN", "Medellín" if s == "door" else "ANTIOQUIA") for s, a in shops],
                               "shop_id string, title string, content string, municipality string, department string")
    targets = gc.geocode_questions(gc.shop_targets(df)).cache()
    assert targets.where("shop_id = 'door'").first().address_query == "Carrera 80 50-87, Medellin, Antioquia"
    long, short = [6.2, 6.22, -75.6, -75.5999], [6.2, 6.201, -75.6, -75.599]
    told = {
        "Carrera 80 50-87": [hit("Carrera 80", 6.2, -75.6, long), hit("Carrera 80", 6.25, -75.6, short, 30, "50-12", category="shop"), hit("Avenida 80", 6.26, -75.6, short, 30, "# 50 - 87", category="shop")],
        "Carrera 81 50-87": [hit("Carrera 81", 6.2, -75.6, long)], "Carrera 82 50-87": [hit("Carrera 82", 6.2, -75.5, [6.2, 6.22, -75.5, -75.4999])],
        "Carrera 83 50-87": [hit("Carrera 83", 6.2, -75.6, short, city="Cali", state="Valle del Cauca")], "Carrera 85 51-87": [hit("Carrera 85", 6.2, -75.6, short)],
        "Carrera 86 52-1": [hit("Carrera 86", 6.2, -75.6, short)], "Carrera 87 53-1": [hit("Carrera 87", 6.2, -75.6, short, village="La Cabaña")],
        "Calle 50": [hit("Calle 50", 6.2, -75.6, [6.2005, 6.2006, -75.601, -75.599])], "Calle 52": [hit("Calle 52", 6.3, -75.6, [6.3, 6.301, -75.6, -75.599])],
    }
    rows = [(f"{q}, Medellin, Antioquia", "every", len(h), h) for q, h in told.items()]
    answers = spark.createDataFrame(rows, f"query string, shape string, raw_count int, hits array<{OSM_HIT}>").withColumn("fetched_at", F.lit("2026-09-01").cast("timestamp"))
    now = F.lit("2026-10-01").cast("timestamp")
    resolved = {r.shop_id: (r.precision or r.geocode_problem, r.latitude) for r in gc.resolve_locations(targets, gc.combine_answers(answers, now)).collect()}
    assert {k: v[0] for k, v in resolved.items()} == {
        "door": "address", "corner": "intersection", "long": "only the street, too long to place", "away": "another municipality", "none": "no result",
        "short": "street", "far cross": "the cross street exists, but far from the street", "hamlet": "short street in a settlement the shop does not name"}
    assert resolved["door"][1] == 6.26
    assert gc.combine_answers(answers, F.lit("2027-10-01").cast("timestamp")).count() == 0
    assert gc.geocode_requests(targets, answers, now).count() == len({"Carrera 84", "Calle 51", "Calle 53"})


def test_trips(spark):
    line = [(-74.0 + i * 0.001, 4.6) for i in range(6)]
    routes = spark.createDataFrame([("r", [{"lng": a, "lat": b} for a, b in line], 555, 111)], "route_id string, coordinates array<struct<lng double, lat double>>, distance_m int, duration_s int")
    fixes = [(0, 4.6, -74.0), (10, 4.6, -73.9985), (20, 4.602, -73.998), (30, 4.602, -73.997), (40, 4.602, -73.996), (50, 4.602, -73.9955), (60, 4.6, -73.995)]
    df = spark.createDataFrame([("t", "r", 1_700_000_000 + s, la, ln) for s, la, ln in fixes], "trip_id string, route_id string, s long, lat double, lng double").withColumn("ts", F.timestamp_seconds("s"))
    got = tr.match_fixes(df, routes).orderBy("ts").collect()
    assert [r.segment for r in got] == [0, 1, 1, 2, 3, 3, 4]
    assert [r.reroute for r in got] == [False, False, False, False, True, False, False]
    assert got[0].remaining_m == round(metres(4.6, -74.0, 4.6, -73.995)) and got[-1].remaining_m == 0
    segments = tr.route_segments(routes).orderBy("segment").collect()
    assert len(segments) == 5 and round(segments[0].remaining_m) == got[0].remaining_m


def test_clean_reads_a_text_once(spark):
    """Folding, dashes, punctuation and blanks in one translation and one pattern give what pattern after pattern gave."""
    odd = [None, "", "  ", "Cra 80 A # 50–87", "Calle  5.º, “Sur”", "á̀  　b", "ÑÚ̀K'#'\t\n x", "x   ", " # ", "Δά—–'.;﻿İ", "a  b   c", "´`Ͱ"]
    rng = random.Random(4)
    odd += ["".join(rng.choice("aÁñ #.,-–— \t ́ \"º") for _ in range(rng.randrange(20))) for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    folded = F.regexp_replace(F.translate(F.lower("t"), MARKED, PLAIN), "[̀-ͯ]", "")
    plain = F.regexp_replace(F.regexp_replace(folded, "[–—]", "-"), '[°º"“”\'.,]', " ")
    blanks = lambda c: F.trim(F.regexp_replace(c, f"{SPACE}+", " "))
    want = [folded, blanks(F.replace(plain, F.lit("#"), F.lit(" # "))), blanks(F.col("t"))]
    got = [fold(F.col("t")), gc.clean(F.col("t")), squeeze(F.col("t"))]
    for r in df.select(F.array(*want).alias("want"), F.array(*got).alias("got")).collect():
        assert r["got"] == r["want"]
    assert str(gc.clean(F.col("t"))).count("regexp_replace") == 1


def test_shops_are_spread_before_they_are_parsed(spark, monkeypatch):
    """Products are few bytes and much work: their file has one row group, that is one task otherwise."""
    monkeypatch.setattr(place_queries, "cut_lineage", lambda df: df)
    plan = place_queries._targets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan
