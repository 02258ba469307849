"""Gates that stop bad runs, constraint checks, and run reports. One row per store; nothing is collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import fixed
from larder.functions.geo import in_country
from larder.functions.text import strip


def unreadable_gate(
    staging: DataFrame, minimum: int = fixed.MIN_SAMPLE, limit: float = fixed.MAX_UNREADABLE_SHARE, key: str = "store"
) -> DataFrame:
    """Per store: seen, ok, skipped, failed, and whether the run is aborted. Skipped rows never count as unreadable."""
    counted = staging.groupBy(key).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("status") == "ok").alias("normalised"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    share = F.col("failed") / F.col("seen")
    return counted.withColumn("unreadable_share", share).withColumn(
        "aborted", (F.col("seen") >= minimum) & (F.coalesce(share, F.lit(0.0)) > limit)
    )


def branch_gate(staging: DataFrame, stores: DataFrame) -> DataFrame:
    """The same for shop sweeps: no minimum, and a store that returned nothing is aborted too."""
    counted = unreadable_gate(staging, minimum=0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return stores.select(F.col("slug").alias("store")).join(counted, "store", "left").select(
        "store",
        *[zero(c) for c in ("seen", "normalised", "skipped", "failed")],
        "unreadable_share",
        F.coalesce("aborted", F.lit(True)).alias("aborted"),
    )


def may_retire(found: Column, missing: Column) -> Column:
    return missing <= found * fixed.MAX_MISSING_SHARE


def retirement_gate(facts: DataFrame) -> DataFrame:
    """Add ``retire_skip``: why vanished rows stay as they are this time, or null when they may be retired.

    ``facts``: dry_run, aborted, partial, pages_dropped, found, missing.
    """
    reason = (
        F.when(F.col("dry_run"), "dry run")
        .when(F.col("aborted"), "run aborted")
        .when(F.col("partial"), "partial run")
        .when(F.col("pages_dropped") > 0, F.concat(F.col("pages_dropped").cast("string"), F.lit(" requests dropped")))
        .when(
            ~may_retire(F.col("found"), F.col("missing")),
            F.concat(F.col("missing").cast("string"), F.lit(" missing of "), F.col("found").cast("string")),
        )
    )
    return facts.withColumn("retire_skip", reason)


def branch_retirement_gate(facts: DataFrame) -> DataFrame:
    """Shop sweeps have neither partial nor dry runs here: holes and too many missing shops decide."""
    plain = facts.withColumns({"dry_run": F.lit(False), "aborted": F.coalesce("aborted", F.lit(False)), "partial": F.lit(False)})
    return retirement_gate(plain)


def count_dropped(fetch_log: DataFrame) -> DataFrame:
    return fetch_log.where("outcome = 'dropped'").groupBy("store").agg(F.count(F.lit(1)).alias("pages_dropped"))


def run_report(
    gate: DataFrame,
    diff: DataFrame,
    fetch_log: DataFrame,
    retirement: DataFrame,
    unpriced: DataFrame,
    errors: DataFrame,
) -> DataFrame:
    """One row per store of a price run.

    ``diff`` carries store and decision; ``retirement`` store, retired, retire_skip; ``unpriced`` store,
    unpriced_before, unpriced_after; ``errors`` store, errors (rows set apart before writing).
    """
    prices = diff.groupBy("store").agg(
        F.count(F.lit(1)).alias("products_upserted"),
        F.count_if(F.col("decision").isin("new", "changed")).alias("prices_changed"),
        F.count_if(F.col("decision") == "jump").alias("price_jumps_rejected"),
    )
    report = gate
    for part in (prices, count_dropped(fetch_log), retirement, unpriced, errors):
        report = report.join(part, "store", "left")
    zero = ["products_upserted", "prices_changed", "price_jumps_rejected", "pages_dropped", "retired", "errors"]
    filled = report.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in zero})
    run_ok = ~F.col("aborted") & (F.col("errors") == 0) & (F.col("pages_dropped") == 0)
    return filled.withColumn("run_ok", run_ok)


def branch_run_report(staging: DataFrame, gate: DataFrame, fetch_log: DataFrame, saturated: DataFrame) -> DataFrame:
    """Gate columns, duplicates, a histogram of skip reasons, dropped requests and saturated points per store.

    The histogram has one entry per reason and the list one per grid point: both are bounded by the job, not the data.
    """
    reasons = (
        staging.where("status = 'skipped'").groupBy("store", "reason").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("store").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("skip_reasons"))
    )
    ok = staging.where("status = 'ok'").groupBy("store").agg(
        (F.count(F.lit(1)) - F.count_distinct("external_id")).alias("duplicates")
    )
    points = saturated.groupBy("store").agg(F.array_sort(F.collect_set("point")).alias("saturated_points"))
    report = gate
    for part in (ok, reasons, count_dropped(fetch_log), points):
        report = report.join(part, "store", "left")
    return report.withColumns(
        {
            "duplicates": F.coalesce("duplicates", F.lit(0).cast("bigint")),
            "requests_dropped": F.coalesce("pages_dropped", F.lit(0).cast("bigint")),
        }
    ).drop("pages_dropped").withColumn("run_ok", ~F.col("aborted") & (F.col("requests_dropped") == 0))


# --- constraints -------------------------------------------------------------------------------------------------


def _filled(name: str) -> Column:
    return F.coalesce(strip(F.col(name)) != "", F.lit(False))


def _null_or(name: str, test: Column) -> Column:
    return F.col(name).isNull() | F.coalesce(test, F.lit(False))


def checks_for(table: str) -> dict[str, Column]:
    """Name -> predicate that must hold on every row of a table."""
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    shape = F.when(
        F.col("frequency") == "monthly", F.col("day_of_month").between(1, 31) & F.col("weekday").isNull()
    ).otherwise(F.col("weekday").between(1, 7) & F.col("day_of_month").isNull())
    tables: dict[str, dict[str, Column]] = {
        "store": {
            "slug_filled": _filled("slug"),
            "source_type": F.col("source_type").isin("api", "scraper", "manual"),
        },
        "store_product": {
            "ean_digits": _null_or("ean", F.col("ean").rlike(fixed.EAN)),
            "name_filled": _filled("name"),
            "unit_kind": F.coalesce(F.col("unit_kind").isin("unit", "weight", "volume"), F.lit(False)),
            "unit_measure": _null_or("unit_measure", F.col("unit_measure").isin(*fixed.UNIT_KIND)),
            "unit_value_positive": _null_or("unit_value", F.col("unit_value") > 0),
            "unit_pair": F.col("unit_value").isNull() == F.col("unit_measure").isNull(),
        },
        "price_snapshot": {
            "price_positive": positive("price_cop"),
            "list_price_positive": _null_or("list_price_cop", F.col("list_price_cop") > 0),
        },
        "shopping_list": {"name_filled": _filled("name")},
        "list_item": {"quantity_positive": positive("quantity"), "price_present": F.col("price_cop_at_add").isNotNull()},
        "list_reminder": {
            "frequency": F.coalesce(F.col("frequency").isin("weekly", "biweekly", "monthly"), F.lit(False)),
            "shape": F.coalesce(shape, F.lit(False)),
            "anchor": (F.col("frequency") != "biweekly") | F.col("anchor_date").isNotNull(),
        },
        "store_branch": {
            "name_filled": _filled("name"),
            "in_country": in_country(F.col("latitude"), F.col("longitude")),
            "source": F.coalesce(F.col("source").isin("official", "osm", "manual"), F.lit(False)),
        },
    }
    return tables[table]


def failed_checks(checks: Mapping[str, Column]) -> Column:
    """Names of the checks a row fails."""
    names = F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()])
    return F.filter(names, lambda n: n.isNotNull())


def check_constraints(df: DataFrame, table: str, keys: Sequence[str], checks: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per violation: table_name, constraint, and the row's key. One pass, no shuffle."""
    broken = failed_checks(checks if checks is not None else checks_for(table))
    return df.select(*keys, F.explode(broken).alias("constraint")).select(
        F.lit(table).alias("table_name"), "constraint", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key")
    )


def check_unique(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(
            F.lit(table).alias("table_name"),
            F.lit("unique").alias("constraint"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
        )
    )


def check_reference(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Values of ``column`` that the parent table does not have, each once."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    return values.join(parent.select(F.col(parent_key).alias("_v")), "_v", "left_anti").select(
        F.lit(table).alias("table_name"),
        F.lit(f"reference_{column}").alias("constraint"),
        F.col("_v").cast("string").alias("key"),
    )


def split_valid(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that may be written, rows set apart with the names of the checks they fail)."""
    judged = df.withColumn("failed_checks", failed_checks(checks))
    good = judged.where(F.size("failed_checks") == 0).drop("failed_checks")
    return good, judged.where(F.size("failed_checks") > 0)
