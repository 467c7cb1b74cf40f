"""Keyed and append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantweave.operators.ordered import latest_per_key
from plantweave.session import shared_folder


def retained(rows: DataFrame, order: list[str], key: str = "topic") -> DataFrame:
    """Latest row per topic; a NULL or empty payload deletes the topic."""
    last = latest_per_key(rows, [key], order)
    return last.filter(F.coalesce(F.col("payload"), F.lit("")) != "")


def append_events(rows: DataFrame, path: str, date_of: str | None = None) -> None:
    """Append rows; with ``date_of`` (epoch ms) partitioned by event date."""
    if date_of is None:
        rows.write.mode("append").parquet(path)
        return
    day = F.to_date(F.timestamp_millis(F.col(date_of)))
    rows.withColumn("event_date", day).write.mode("append").partitionBy("event_date").parquet(path)


class KeyedTable:
    """Current row per key, kept as numbered versions of a parquet folder.

    A merge writes a new version from the last one; readers see finished versions
    only, so a failed or repeated merge leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    @classmethod
    def scratch(cls, spark: SparkSession, name: str, schema: str) -> "KeyedTable":
        return cls(spark, shared_folder(spark, name), schema)

    def _fs(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder, jvm

    def versions(self) -> list[int]:
        fs, folder, jvm = self._fs()
        if not fs.exists(folder):
            return []
        done = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            success = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("v") and name[1:].isdigit() and fs.exists(success):
                done.append(int(name[1:]))
        return sorted(done)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest finished version, or the newest below ``before``."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{known[-1]}")

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def upsert(self, rows: DataFrame, keys: list[str], order: list[str], version: int) -> None:
        """Write ``version``: the latest row per key of the version before and ``rows``.

        Repeating a version gives the same table, so a retried batch does no harm.
        """
        both = self.read(before=version).unionByName(rows)
        self.write(latest_per_key(both, keys, order), version)
