"""Shared plumbing: written tables, column access, word hashing.

Intermediate tables are Parquet folders below ``spark.checkpoint.dir``, which
driver and executors share, so a lost executor never takes results with it.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words a worker remembers before it starts its table anew, and bytes of the longest that it remembers: some 40 MB. Executors may hold several workers at once.
WORD_CACHE, LONG_WORD = 1 << 18, 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of its own only where none is set and all runs on this machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weir-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def new_path(spark: SparkSession, name: str) -> str:
    """A place for a table; it goes with the application at the latest."""
    top = f"{shared_dir(spark)}/weir-tables/{spark.sparkContext.applicationId}"
    if top not in _TOPS:
        fs, path = file_system(spark, top)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _TOPS.add(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


_TOPS: set[str] = set()
_SCRATCH: list[list[DataFrame]] = []


def cut(df: DataFrame, name: str, codec: str = "snappy", stays: bool = False) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back: cuts lineage. ``stays``: not deleted by ``scratch``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weir_path = path
    if _SCRATCH and not stays:
        _SCRATCH[-1].append(out)
    return out


def cut_buckets(df: DataFrame, name: str, key: str, buckets: int, codec: str = "zstd") -> DataFrame:
    """As ``cut``, in buckets of a column: a join on it reads the rows where they lie and exchanges only the other side."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"weir_{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("path", path).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {table}")
    out._weir_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for t in tables:
        fs, path = file_system(t.sparkSession, t._weir_path)
        fs.delete(path, True)


@contextlib.contextmanager
def scratch():
    """Delete at the end the tables that were cut inside."""
    mine: list[DataFrame] = []
    _SCRATCH.append(mine)
    try:
        yield
    finally:
        _SCRATCH.pop()
        drop(*mine)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send workers at most so many rows at a time, for operators that hold tables of their own next to a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """While tables are written inside, workers get at most so many rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), rows) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def slices(batches, rows: int = 256):
    """Batches of at most so many rows, so that few texts at a time become Python objects."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def to_signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


class WordHashes(dict):
    """Word bytes to a 64-bit hash; call ``trim`` between documents to bound it. Long words are not remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def trim(self) -> None:
        if len(self) > WORD_CACHE:
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise (public-domain splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One Arrow list per part, without Python objects for the elements."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), type=kind))


def docs_view(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that clashing extra columns cannot matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
