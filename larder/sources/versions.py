"""A keyed table in hash buckets, with versions: a commit writes only the buckets that its rows touch.

Below ``path`` lie ``data/version=000000003/bucket=17/`` with the rows a commit wrote, and ``manifests/000000003.json``, which
names the version that holds each bucket. A manifest is written aside and renamed into place once its data is complete, and
never changes after that: the manifest of the highest number is what readers see, and a commit that is repeated does nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.sources.sinks import FILE_RECORDS

#: Rows that a bucket is to hold, some 50 MB; every bucket that a commit touches costs at least one file.
BUCKET_ROWS = 2_000_000
BUCKETS = 64
BUCKET = "bucket"


def buckets_for(rows: int) -> int:
    """Buckets of a table that is expected to grow to ``rows``: 8 to 4096, as the list of them goes through the driver."""
    return max(8, min(4096, -(-rows // BUCKET_ROWS)))


class Versions:
    """Versions of one table. ``schema``, ``key`` and ``buckets`` are fixed by version 0 and read from its manifest later.

    Null keys are a key like others. A table without rows is a version without buckets. Columns may have any name but ``bucket``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, rows: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> None:
        """Version 0 from ``rows``; nothing happens where it is there already, so a restarted job may call it again."""
        if BUCKET in rows.columns:
            raise ValueError(f"a column of the table is named {BUCKET}")
        if not self._has(0):
            head = {"schema": rows.schema.jsonValue(), "key": list(key), "buckets": buckets, "held": {}}
            self._finish(0, self._write(0, rows, head), head)

    def commit(self, version: int, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Build ``version`` out of the one before it: ``merge(rows of the touched buckets, changes)`` replaces those buckets.

        ``merge`` must give rows of the keys it gets only. The numbers of the touched buckets, at most ``buckets``, are the one
        thing that comes to the driver.
        """
        if self._has(version):
            return
        head = self.manifest(version - 1)
        changes = changes.persist()
        try:
            touched = [r[0] for r in changes.select(self._bucket(head).alias(BUCKET)).distinct().collect()]
            written = self._write(version, merge(self.read(version - 1, touched), changes), head) if touched else []
        finally:
            changes.unpersist()
        left = {b: v for b, v in head["held"].items() if b not in touched}
        self._finish(version, written, head | {"held": left})

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version, the latest one by default, or of some of its buckets."""
        head = self.manifest(version)
        schema = StructType.fromJson(head["schema"])
        folders = [f"{self._data(v)}/{BUCKET}={b}" for b, v in sorted(head["held"].items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def latest(self) -> int:
        """Number of the version that readers see."""
        return max(self._numbers("manifests"))

    def manifest(self, version: int | None = None) -> dict:
        """Schema, key, number of buckets, and the version that holds each bucket."""
        stream = self._fs.open(self._paths(self._manifest(self.latest() if version is None else version)))
        try:
            head = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return head | {"held": {int(b): v for b, v in head["held"].items()}}

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the last ``keep`` versions holds; who reads an older version meanwhile loses its files."""
        numbers = sorted(self._numbers("manifests"))
        kept = numbers[-max(keep, 1):]
        held = {(v, b) for n in kept for b, v in self.manifest(n)["held"].items()}
        for n in numbers[: -len(kept)]:
            self._fs.delete(self._paths(self._manifest(n)), False)
        for v in self._numbers("data"):
            stale = [b for b in self._written(v) if (v, b) not in held] if v <= kept[-1] else []
            for b in stale:
                self._fs.delete(self._paths(f"{self._data(v)}/{BUCKET}={b}"), True)

    def _bucket(self, head: dict) -> Column:
        types = StructType.fromJson(head["schema"])
        return F.pmod(F.xxhash64(*[F.col(k).cast(types[k].dataType) for k in head["key"]]), F.lit(head["buckets"])).cast("int")

    def _write(self, version: int, rows: DataFrame, head: dict) -> list[int]:
        """Write the rows by bucket, where adaptive plans split a large one, and return the buckets that have some."""
        types = StructType.fromJson(head["schema"])
        (
            rows.select(*[F.col(f.name).cast(f.dataType) for f in types], self._bucket(head).alias(BUCKET))
            .hint("rebalance", BUCKET)
            .write.mode("overwrite")
            .option("maxRecordsPerFile", FILE_RECORDS)
            .partitionBy(BUCKET)
            .parquet(self._data(version))
        )
        return self._written(version)

    def _finish(self, version: int, written: list[int], head: dict) -> None:
        held = head["held"] | dict.fromkeys(written, version)
        target = self._paths(self._manifest(version))
        aside = self._paths(f"{self.path}/_aside-{version:09d}.json")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(head | {"held": held}, sort_keys=True).encode()))
        finally:
            out.close()
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(aside, target) and not self._has(version):
            raise OSError(f"version {version} could not be published")

    def _written(self, version: int) -> list[int]:
        return [int(n.split("=")[1]) for n in self._names(self._data(version)) if n.startswith(f"{BUCKET}=")]

    def _numbers(self, folder: str) -> list[int]:
        names = [n.removesuffix(".json").split("=")[-1] for n in self._names(f"{self.path}/{folder}")]
        return [int(n) for n in names if n.isdigit()]

    def _names(self, folder: str) -> list[str]:
        where = self._paths(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _has(self, version: int) -> bool:
        return self._fs.exists(self._paths(self._manifest(version)))

    def _data(self, version: int) -> str:
        return f"{self.path}/data/version={version:09d}"

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:09d}.json"
