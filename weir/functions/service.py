"""The SQL service's envelope: results, schema, health, errors, retry, statistics."""

from __future__ import annotations

import itertools
import json
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binding import BindingError, SqlNodeConfig, run_sql
from .exprs import json_row


@dataclass
class QueryResponse:
    success: bool
    data: list[dict] = field(default_factory=list)
    message: str = ""
    execution_time_ms: int = 0
    truncated: bool = False
    row_count: int = 0
    bytes: int = 0


class PoolExhausted(RuntimeError):
    """No free place to run a query."""


#: Error kinds and whether trying again can help; the first that fits counts.
ERRORS = {
    ParseException: ("parse", False),
    AnalysisException: ("analysis", False),
    BindingError: ("configuration", False),
    ConnectionError: ("connection", True),
    TimeoutError: ("timeout", True),
    PoolExhausted: ("pool", True),
    OSError: ("io", True),
    json.JSONDecodeError: ("format", False),
    PySparkException: ("execution", False),
}


def classify(error: Exception) -> tuple[str, bool]:
    for kind, out in ERRORS.items():
        if isinstance(error, kind):
            return out
    return "unknown", "UNAVAILABLE" in str(error) or "Connection refused" in str(error)


def retry(call, attempts: int = 3, backoff: float = 0.1):
    """Call again after retryable errors, each time ``backoff`` seconds later than before."""
    for k in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if k == attempts or not classify(e)[1]:
                raise
            time.sleep(backoff * k)


#: What names a job group on a thread.
JOB_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


def within(spark: SparkSession, seconds: float | None, call):
    """``call()``; its Spark jobs are cancelled, and TimeoutError raised, if it takes longer."""
    if not seconds:
        return call()
    tag, late, done = f"weir-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch():
        if done.wait(seconds):
            return
        late.set()
        while not done.wait(0.2):  # also jobs that begin after the time is up
            spark.sparkContext.cancelJobGroup(tag)

    was = {k: spark.sparkContext.getLocalProperty(k) for k in JOB_GROUP}
    spark.sparkContext.setJobGroup(tag, "bounded in time", interruptOnCancel=True)  # or its tasks would run on
    clock = threading.Thread(target=watch, daemon=True)
    clock.start()
    try:
        out = call()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} s") from None
        raise
    finally:
        done.set()
        clock.join()
        for k, v in was.items():
            spark.sparkContext.setLocalProperty(k, v)
    return out


def execute(spark: SparkSession, sql: str, parameters: dict | list | None = None, limit: int | None = None, timeout: float | None = 300) -> QueryResponse:
    """The rows of a statement as dicts, with their number and JSON bytes; errors become an envelope without data. With ``limit`` at most so many rows, ``truncated`` if there are more."""
    began = time.time()

    def rows():
        df = run_sql(spark, sql, parameters)
        return (df.limit(limit + 1) if limit is not None else df).collect()

    try:
        found = [r.asDict(recursive=True) for r in within(spark, timeout, rows)]
        cut = limit is not None and len(found) > limit
        found = found[:limit] if cut else found
        size = sum(len(json.dumps(r, default=str, separators=(",", ":"))) for r in found)
        return QueryResponse(True, found, f"only the first {limit} rows" if cut else "", int((time.time() - began) * 1000), cut, len(found), size)
    except Exception as e:
        return QueryResponse(False, [], f"{classify(e)[0]}: {str(e).splitlines()[0]}", int((time.time() - began) * 1000))


def schema_of(spark: SparkSession, sql: str) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of the result, without running it."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in spark.sql(sql).schema.fields]


def healthy(spark: SparkSession) -> bool:
    return spark.sql("select 1 as ok").first()["ok"] == 1


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(json_row(*df.columns).alias("value"))


def node_batches(spark: SparkSession, config: SqlNodeConfig, df: DataFrame, attempts: int = 3, backoff: float = 0.1):
    """A SQL node's rows as JSON lines in lists of ``batchSize``; the statement runs once over all rows of ``input``, within ``timeout`` and again after retryable errors, one partition at a time on the driver."""

    def run():
        out = json_lines(run_sql(spark, config.sql, config.parameters, input=df))
        return out.toLocalIterator(prefetchPartitions=True)

    rows = retry(lambda: within(spark, config.timeout, run), attempts, backoff)
    while some := [r[0] for r in itertools.islice(rows, config.batch_size)]:
        yield some


def from_json_lines(spark: SparkSession, lines: DataFrame, schema: str | None = None) -> DataFrame:
    """Rows of JSON lines; any bad line fails. Without a schema the first line gives it."""
    if schema is None:
        first = lines.first()
        schema = spark.range(1).select(F.schema_of_json(F.lit(first[0]))).first()[0] if first else "struct<>"
    return lines.select(F.from_json(F.col(lines.columns[0]), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def result_stats(df: DataFrame) -> dict:
    return {"row_count": df.count(), "column_count": len(df.columns), "types": dict(df.dtypes)}
