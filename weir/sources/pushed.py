"""A source that callers push rows to: a bounded buffer of files, read as a stream."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class BufferFull(RuntimeError):
    pass


class PushSource:
    """Rows go to JSON files in a shared folder. At most ``capacity`` files may wait; a further one raises, or by policy drops the oldest (``drop_head``), itself (``drop_new``) or all that wait (``drop_buffer``)."""

    def __init__(self, spark: SparkSession, schema: str, path: str, capacity: int = 100, policy: str = "fail"):
        if policy not in ("fail", "drop_head", "drop_new", "drop_buffer"):
            raise ValueError(f"unknown policy {policy}")
        self.spark, self.schema, self.path, self.capacity, self.policy = spark, schema, path.rstrip("/"), capacity, policy
        self.number = 0
        self._files().mkdirs(self._path(""))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def waiting(self) -> list[str]:
        return sorted(n for s in self._files().listStatus(self._path("")) if (n := s.getPath().getName()).endswith(".json"))

    def push(self, rows: list[dict]) -> bool:
        """Add a batch of rows; whether it was taken."""
        names = self.waiting()
        if len(names) >= self.capacity:
            if self.policy == "fail":
                raise BufferFull(f"{len(names)} batches wait")
            if self.policy == "drop_new":
                return False
            for n in names[:1] if self.policy == "drop_head" else names:
                self._files().delete(self._path(n), False)
        files, hidden = self._files(), self._path(f".{uuid.uuid4().hex}")
        out = files.create(hidden)
        out.write(bytearray("\n".join(json.dumps(r, default=str) for r in rows).encode()))
        out.close()
        self.number += 1
        return bool(files.rename(hidden, self._path(f"{self.number:012d}.json")))  # appears whole

    def stream(self, batches: int = 1) -> DataFrame:
        """The rows as a stream, ``batches`` pushes to a trigger at most."""
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", batches).json(self.path)


class Numbers(DataSource):
    """A data source in Python: whole numbers ``start`` to ``end`` in ``partitions`` parts. A pattern for sources of one's own."""

    @classmethod
    def name(cls) -> str:
        return "weir_numbers"

    def schema(self) -> str:
        return "value long"

    def reader(self, schema):
        return _NumbersReader(self.options)


class _NumbersReader(DataSourceReader):
    def __init__(self, options):
        self.start, self.end, self.parts = int(options.get("start", 1)), int(options.get("end", 100)), int(options.get("partitions", 2))

    def partitions(self):
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(range(self.start + partition.value, self.end + 1, self.parts), pa.int64())], names=["value"])
