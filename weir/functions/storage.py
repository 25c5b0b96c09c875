"""Folders for what an operator has to write: below the cluster's shared folder, deleted with the application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KNOWN: set[str] = set()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where none is set, below a temporary folder if all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.gettempdir()
    top = f"{top.rstrip('/')}/weir-work/{spark.sparkContext.applicationId}"
    if top not in _KNOWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _KNOWN.add(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read again: one evaluation for several readers, and plain rows that skewed joins can split."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drained(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """All that a bounded stream gives, through a checkpointed query that ends with its input; ``complete`` keeps the last state."""
    spark = stream.sparkSession
    out, state = work_dir(spark, name), work_dir(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(out).awaitTermination()
    else:
        # A repeated batch writes the same folder again.
        writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
