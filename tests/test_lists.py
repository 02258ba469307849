"""Batches of saves against a replay one by one, and the totals of an edited list."""

import json
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import lists as li
from larder.operators.save_chain import refused_saves

ITEMS = "list_id string, store_product_id string, quantity decimal(10,3), position int, price_cop_at_add int"


def replay(saves, lists, items, regions, prices):
    """What the saves do one after the other: (error by save, items, names)."""
    held = {}
    for list_id, product, quantity, position, price in items:
        held.setdefault(list_id, {})[product] = (float(quantity), position, price)
    known, errors = {i: [owner, name, archived] for i, owner, name, archived in lists}, {}
    for save_id, _, owner, list_id, is_new, name, payload in sorted(saves, key=lambda s: s[1]):
        last = {}
        for at, entry in enumerate(json.loads(payload)):
            last[entry["store_product_id"]] = (entry["quantity"], at)
        before = held.get(list_id, {})
        price = lambda p: prices.get((p, regions.get(owner, "NACIONAL")), prices.get((p, "NACIONAL")))  # noqa: B023, E731
        if owner is None:
            errors[save_id] = "42501"
        elif not last:
            errors[save_id] = "22023"
        elif len(name.strip()) > 100:
            errors[save_id] = "22001"
        elif any(q is None or not 0.001 <= q <= 999 for q, _ in last.values()):
            errors[save_id] = "22003"
        elif not is_new and (list_id not in known or known[list_id][2] or known[list_id][0] != owner):
            errors[save_id] = "P0002"
        elif any(p not in before and price(p) is None for p in last):
            errors[save_id] = "P0001"
        else:
            errors[save_id] = None
            held[list_id] = {p: (q, at, before[p][2] if p in before else price(p)) for p, (q, at) in last.items()}
            known[list_id] = [known.get(list_id, [owner])[0], name.strip(), False]
    return errors, {(k, p): v for k, ps in held.items() for p, v in ps.items()}, {k: v[1] for k, v in known.items()}


def applied(spark, saves, lists, items, regions, prices, target_rows):
    items_df = spark.createDataFrame(items, "list_id string, store_product_id string, q string, position int, price_cop_at_add int").select(
        "list_id", "store_product_id", F.col("q").cast("decimal(10,3)").alias("quantity"), "position", "price_cop_at_add")
    verdicts, after, headers = li.apply_list_saves(
        spark.createDataFrame(saves, "save_id string, seq int, owner_id string, list_id string, is_new boolean, name string, items string"),
        spark.createDataFrame(lists, "id string, owner_id string, name string, is_archived boolean"), items_df,
        spark.createDataFrame(list(regions.items()), "id string, region_code string"),
        spark.createDataFrame([(p, r, c) for (p, r), c in prices.items()], "store_product_id string, region_code string, price_cop int"), target_rows)
    got = {(r.list_id, r.store_product_id): (float(r.quantity), r.position, r.price_cop_at_add) for r in after.collect()}
    return {r.save_id: r.error for r in verdicts.collect()}, got, {r.id: r.name for r in headers.collect()}


def test_batches_equal_a_replay(spark):
    random.seed(11)
    prices = {(f"p{i}", "NACIONAL"): 100 * (i + 1) for i in range(8) if i not in (3, 7)} | {("p1", "BOG"): 999}
    regions = {"o1": "BOG", "o2": "MDE"}
    lists = [("l1", "o1", "old", False), ("l2", "o2", "old", False), ("l3", "o1", "gone", True)]
    items = [("l1", "p3", "1.000", 0, 77), ("l1", "p1", "2.000", 1, 55), ("l2", "p7", "1.000", 0, 33), ("l3", "p1", "1.000", 0, 10)]
    saves = []
    for n in range(60):
        list_id = random.choice(["l1", "l1", "l1", "l2", "l3", "n1", "n2", "lost"])
        owner = {"l1": "o1", "l2": "o2", "l3": "o1", "n1": "o1", "n2": "o2"}.get(list_id, "o1")
        owner = None if n == 17 else owner
        count = 0 if n == 23 else random.randint(1, 5)
        entries = [{"store_product_id": f"p{random.randint(0, 7)}", "quantity": random.choice([1, 2, 2.5, 3])} for _ in range(count)]
        if n == 31:
            entries[-1]["quantity"] = 1000
        name = "x" * 101 if n == 41 else f" save {n} "
        saves.append((f"s{n}", n, owner, list_id, list_id in ("n1", "n2"), name, json.dumps(entries)))
    want = replay(saves, lists, items, regions, prices)
    assert {"22023", "22003", "22001", "42501", "P0001", "P0002", None} == set(want[0].values())
    assert applied(spark, saves, lists, items, regions, prices, 4) == want


@pytest.mark.parametrize("target_rows", [1_000_000, 40])
def test_saves_are_followed_across_batches_without_jobs_on_the_way(spark, target_rows):
    """Lists and saves that reach over Arrow batches equal a replay; only the count of long lists runs while it is planned."""
    random.seed(7)
    prices = {(f"p{i}", "NACIONAL"): 100 * (i + 1) for i in range(9) if i % 3}
    regions, lists, items, saves = {"o1": "BOG"}, [], [], []
    for k in range(4):
        lists.append((f"l{k}", "o1", "old", k == 3))
        items += [(f"l{k}", f"p{i}", "2.500", i, 10 * k + i) for i in range(9) if random.random() < 0.7]
    for n in range(150):
        entries = [{"store_product_id": f"p{random.randint(0, 8)}", "quantity": random.choice([1, 2.5])} for _ in range(random.randint(1, 9))]
        list_id = random.choice(["l0", "l0", "l1", "l3", "n1"])
        saves.append((f"s{n}", n, "o1", list_id, list_id == "n1" and n > 40, f"save {n}", json.dumps(entries)))
    want = replay(saves, lists, items, regions, prices)
    assert {"P0001", "P0002", None} == set(want[0].values())
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert applied(spark, saves, lists, items, regions, prices, target_rows) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    if target_rows > len(saves):
        frames = [spark.createDataFrame(rows, schema) for rows, schema in [
            (saves, "save_id string, seq int, owner_id string, list_id string, is_new boolean, name string, items string"),
            (lists, "id string, owner_id string, name string, is_archived boolean"), ([], ITEMS), (list(regions.items()), "id string, region_code string"),
            ([(p, r, c) for (p, r), c in prices.items()], "store_product_id string, region_code string, price_cop int")]]
        spark.sparkContext.setJobGroup("planning", "planning")
        try:
            li.apply_list_saves(*frames)
            assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) <= 4
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("target_rows", [1_000_000, 50])
def test_a_thousand_saves_that_put_back_what_is_gone(spark, target_rows):
    """Products without a price leave a list one by one; saves that still have one of those gone are refused, in one pass."""
    random.seed(5)
    prices, regions, lists = {("p0", "NACIONAL"): 100}, {"o1": "BOG"}, [("l1", "o1", "old", False), ("l2", "o1", "old", False)]
    items = [(li_id, f"p{i}", "1.000", i, 50 + i) for li_id in ("l1", "l2") for i in range(1, 9)]
    saves = []
    for n in range(1300):
        left = range(1, 9) if n < 20 else range(1, random.choice([3, 9, 9, 9]))
        taken = ["p0"] + [f"p{i}" for i in left if n < 20 or random.random() < 0.7]
        entries = [{"store_product_id": p, "quantity": 1 + n % 5} for p in taken]
        saves.append((f"s{n}", n, "o1", "l2" if n % 60 == 1 else "l1", False, f"save {n}", json.dumps(entries)))
    want = replay(saves, lists, items, regions, prices)
    assert sum(e == "P0001" for e in want[0].values()) > 1000
    assert applied(spark, saves, lists, items, regions, prices, target_rows) == want


@pytest.mark.parametrize("seed", range(4))
def test_refused_saves_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    products, saves, held, want = [f"p{i}" for i in range(5)], [], [], set()
    for k, n in enumerate([90, 30, 1]):
        state = set(rng.sample(products, 4))
        if k < 2:
            held.append((k, sorted(state)))
        else:
            state = set()
        for seq in range(n):
            has = set(rng.sample(products, rng.randint(0, 5)))
            needs = {p for p in has if rng.random() < 0.7}
            saves.append((f"{k}-{seq}", k, seq, sorted(needs), sorted(has)))
            if needs <= state:
                state = has
            else:
                want.add(f"{k}-{seq}")
    rng.shuffle(saves)
    save_rows = spark.createDataFrame(saves, "save_id string, list_id int, seq int, needs array<string>, has array<string>")
    held_rows = spark.createDataFrame(held, "list_id int, held array<string>")
    assert want
    for target in (1_000_000, 7, 2):
        got = [r.save_id for r in refused_saves(save_rows, held_rows, target).collect()]
        assert len(got) == len(want) and set(got) == want


def test_totals_of_an_edited_list(spark):
    items = spark.createDataFrame([("l", "a", 3, 0, 4200), ("l", "b", 1, 1, 15000)], "list_id string, store_product_id string, quantity int, position int, price_cop_at_add int")
    lists = spark.createDataFrame([("l", "o", "x", False), ("empty", "o", "y", False), ("orphan", "zz", "z", False)], "id string, owner_id string, name string, is_archived boolean")
    profiles = spark.createDataFrame([("o", "BOG")], "id string, region_code string")
    products = spark.createDataFrame([("a", "s1"), ("b", "s2")], "id string, store_id string")
    current = spark.createDataFrame([("a", "NACIONAL", 5000)], "store_product_id string, region_code string, price_cop int")
    totals = li.list_totals(items, lists, profiles, products, current)
    summary = {r.id: r for r in li.list_summary(lists, totals).collect()}
    assert (summary["l"].total_cop, summary["l"].total_at_add_cop, summary["l"].store_count) == (30000, 27600, 2)
    assert (summary["empty"].total_cop, summary["empty"].item_count) == (0, 0)
    drift = {r.store_product_id: r for r in li.item_drift(items, lists, profiles, current).collect()}
    assert (drift["a"].delta_cop, drift["a"].direction, drift["a"].percent) == (800, "up", 19) and drift["b"].no_price_today


def test_parse_list_items_as_a_table_function(spark):
    li.register_parse_list_items(spark)
    payload = json.dumps([{"store_product_id": "a", "quantity": 1}, {"store_product_id": "b", "quantity": 2}, {"store_product_id": "a", "quantity": 3}])
    spark.createDataFrame([(payload,)], "p string").createOrReplaceTempView("payloads")
    rows = spark.sql("select i.* from payloads, lateral parse_list_items(p) i").collect()
    assert sorted(tuple(r) for r in rows) == [("a", "3", 2), ("b", "2", 1)]
