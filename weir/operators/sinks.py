"""Sink nodes: each takes (spark, config, input), writes, and returns the rows shown, if any."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import json_row
from ..sources import embedded


def _lines(df: DataFrame) -> DataFrame:
    return df.select("value") if "value" in df.columns else df.select(json_row(*df.columns).alias("value"))


def console(spark: SparkSession, c: dict, df: DataFrame):
    """Print the rows; all of them, one partition at a time, unless a ``limit`` is asked for. Returns the rows only with a limit."""
    if "limit" not in c:
        for r in df.toLocalIterator(prefetchPartitions=True):
            print(r)
        return None
    rows = df.limit(int(c["limit"])).collect()
    for r in rows:
        print(r)
    return rows


def file_text(spark: SparkSession, c: dict, df: DataFrame):
    """A folder of text lines; ``single`` makes one file of it, through one task."""
    lines = _lines(df.orderBy("_seq") if c.get("single") and "_seq" in df.columns else df)
    (lines.coalesce(1) if c.get("single") else lines).write.mode("overwrite").text(c["path"])


def file_format(kind: str):
    def write(spark: SparkSession, c: dict, df: DataFrame):
        writer = df.write.mode(c.get("mode", "overwrite"))
        (writer.partitionBy(*c["partitionBy"]) if c.get("partitionBy") else writer).format(kind).save(c["path"])

    return write


def file_transfer(spark: SparkSession, c: dict, df: DataFrame):
    file_format(c.get("format", "parquet"))(spark, c, df)


def mysql_write(spark: SparkSession, c: dict, df: DataFrame):
    """Append rows over JDBC. ``upsert`` appends to a table of its own, which the server then merges by ``keys`` in one statement."""
    url = c.get("url") or f"jdbc:mysql://{c['host']}:{c.get('port', 3306)}/{c['database']}"
    mode, target = c.get("mode", "insert"), c["table"]
    if mode not in ("insert", "upsert"):
        raise ValueError(f"unknown mode {mode}")
    options = {"url": url, "user": c.get("username", ""), "password": c.get("password", ""), "batchsize": str(int(c.get("batchSize", 1000)))} | ({"driver": c["driver"]} if "driver" in c else {})
    if mode == "insert":
        _save(df, options, target, "append")
        return
    staging = f"{target}_{uuid.uuid4().hex[:12]}"
    _save(df, options, staging, "overwrite")
    execute(spark, options, [merge_statement(url, target, staging, df.columns, c["keys"]), f"DROP TABLE {staging}"])


def _save(df: DataFrame, options: dict, table: str, mode: str) -> None:
    if embedded.drivers_own(df.sparkSession, options["url"]):
        embedded.save(df, options, table, mode)
    else:
        df.write.format("jdbc").options(**options, dbtable=table).mode(mode).save()


def merge_statement(url: str, target: str, staging: str, columns: list[str], keys: list[str]) -> str:
    """Rows of ``staging`` into ``target`` by key, in MySQL's or in standard SQL."""
    own = url.startswith("jdbc:mysql:")
    quoted = lambda x: f"`{x}`" if own else f'"{x}"'  # noqa: E731  as Spark names the columns of tables it makes
    rest, keys, columns = [quoted(x) for x in columns if x not in keys], [*map(quoted, keys)], [*map(quoted, columns)]
    names = ", ".join(columns)
    if own:
        return f"INSERT INTO {target} ({names}) SELECT {names} FROM {staging} ON DUPLICATE KEY UPDATE " + ", ".join(f"{x} = VALUES({x})" for x in rest or keys)
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{x} = s.{x}' for x in rest)}" if rest else ""
    return f"MERGE INTO {target} t USING {staging} s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{x}' for x in columns)})"


def execute(spark: SparkSession, options: dict, statements: list[str]) -> None:
    """Run statements on one connection of the driver's."""
    jvm = spark._jvm
    settings = jvm.java.util.Properties()
    for k in ("user", "password"):
        if options.get(k):
            settings.setProperty(k, options[k])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], settings)
    try:
        for text in statements:
            connection.createStatement().execute(text)
    finally:
        connection.close()


def fold(spark: SparkSession, c: dict, df: DataFrame):
    """A stream fold as an aggregate: ``sum``, ``count``, ``min``, ``max``, ``first`` or ``last`` (by ``_seq``) of ``field``, one row."""
    kind, field = c.get("kind", "count"), c.get("field", "value")
    number = F.col(field).try_cast("double") if kind != "count" else None
    order = F.col("_seq") if "_seq" in df.columns else F.lit(0)
    what = {"sum": lambda: F.sum(number), "count": lambda: F.count("*"), "min": lambda: F.min(number), "max": lambda: F.max(number), "first": lambda: F.min_by(field, order), "last": lambda: F.max_by(field, order)}
    return df.agg(what[kind]().alias(kind)).collect()


def foreach(spark: SparkSession, c: dict, df: DataFrame):
    """Call ``each(rows)`` on the executors with every batch of rows."""
    each = c["each"]

    def run(batches):
        for b in batches:
            each(b.to_pylist())
            yield b.slice(0, 0)

    df.mapInArrow(run, df.schema).write.format("noop").mode("overwrite").save()


def kafka_producer(spark: SparkSession, c: dict, df: DataFrame):
    _lines(df).write.format("kafka").option("kafka.bootstrap.servers", c["brokers"]).option("topic", c["topic"]).save()


def count(spark: SparkSession, c: dict, df: DataFrame):
    return df.agg(F.count("*").alias("count")).collect()


def discard(spark: SparkSession, c: dict, df: DataFrame):
    df.write.format("noop").mode("overwrite").save()


SINKS = {
    "console.log": console,
    "file.text": file_text,
    "file.json": file_format("json"),
    "file.parquet": file_format("parquet"),
    "file.csv": file_format("csv"),
    "file.transfer": file_transfer,
    "mysql.write": mysql_write,
    "mysql.sink": mysql_write,
    "kafka.producer": kafka_producer,
    "aggregate.count": count,
    "ignore": discard,
    "fold": fold,
    "foreach": foreach,
}
