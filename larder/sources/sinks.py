"""Parquet sinks. Writes are idempotent: keys are deterministic, and a whole table is swapped in by its version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_RECORDS = 5_000_000


def write_catalog(catalog: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Replace only the store folders present in ``catalog``; the others stay as they are.

    Rows are dealt by store, where adaptive plans split a large store by size over as many tasks as it needs. Stage the
    rows elsewhere first when they were read from ``path`` itself (see ``plans.price_run``).
    """
    (
        catalog.hint("rebalance", "store_slug")
        .sortWithinPartitions("store_slug", "category_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", file_records)
        .partitionBy("store_slug")
        .parquet(path)
    )


def append_prices(snapshots: DataFrame, path: str, run_id: str, file_records: int = FILE_RECORDS) -> None:
    """Add a run's snapshots under its own folder, so the same run written twice is still written once."""
    month = F.date_format("captured_at", "yyyy-MM")
    (
        snapshots.withColumn("captured_month", month)
        .withColumn("run_id", F.lit(run_id))
        .hint("rebalance", "captured_month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", file_records)
        .partitionBy("captured_month", "run_id")
        .parquet(path)
    )


def publish_current(current: DataFrame, path: str, version: str) -> str:
    """Write current prices as a new version beside the old ones and return its path; readers switch by path."""
    target = f"{path}/version={version}"
    current.write.mode("overwrite").parquet(target)
    return target
