"""Snapshot, then changes: a streaming upsert into a folder of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cdc import apply_changes


class VersionedTable:
    """A table as numbered Parquet folders; a version is written whole before it counts, so a lost job repeats it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        folder, fs = self._files()
        if not fs.exists(folder):
            return -1
        done = [s.getPath() for s in fs.listStatus(folder) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(p.getName().split("=")[-1]) for p in done), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the last."""
        return self.spark.read.parquet(f"{self.path}/v={self.version() if version is None else version}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")


def sync(changes: DataFrame, table: VersionedTable, key: str, position: str, kind: str, delete: str, checkpoint: str):
    """Start the query that merges each batch of changes; version n + 1 is batch n, so a repeated batch writes the same version."""

    def merge(batch: DataFrame, number: int) -> None:
        if table.version() <= number:
            base = table.spark.read.parquet(f"{table.path}/v={number}")
            table.write(apply_changes(base, batch, key, position, kind, delete), number + 1)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
