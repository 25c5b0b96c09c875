"""Source nodes: each builder takes (spark, config) and returns a DataFrame, lazily."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import SqlNodeConfig, run_sql
from . import embedded


def random_numbers(spark: SparkSession, c: dict) -> DataFrame:
    """``count`` whole numbers from min to max, both included."""
    low, high = int(c.get("min", 1)), int(c.get("max", 100))
    return spark.range(int(c.get("count", 100))).select(F.col("id").alias("_seq"), (F.floor(F.rand(int(c.get("seed", 42))) * (high - low + 1)) + low).cast("string").alias("value"))


def sequence_numbers(spark: SparkSession, c: dict) -> DataFrame:
    """start, start + step, ... up to ``end``, which is included."""
    start, end, step = int(c.get("start", 1)), int(c.get("end", 100)), int(c.get("step", 1))
    if not step:
        raise ValueError("step must not be 0")
    n = max(0, (end - start) // step + 1)
    return spark.range(n).select(F.col("id").alias("_seq"), (F.col("id") * step + start).cast("string").alias("value"))


def _numbered(df: DataFrame) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("_seq"), "value")


def file_text(spark: SparkSession, c: dict) -> DataFrame:
    return _numbered(spark.read.text(c["path"]))


def file_csv(spark: SparkSession, c: dict) -> DataFrame:
    """Typed columns with a schema or header; else the raw lines that aren't empty."""
    if c.get("schema") or c.get("header"):
        reader = spark.read.option("sep", c.get("delimiter", ",")).option("header", bool(c.get("header")))
        return (reader.schema(c["schema"]) if c.get("schema") else reader).csv(c["path"])
    return _numbered(spark.read.text(c["path"]).filter(F.length("value") > 0))


def memory_collection(spark: SparkSession, c: dict) -> DataFrame:
    """A list gives its elements as compact JSON, a string one record."""
    data = c.get("data")
    if not isinstance(data, (list, str)):
        raise ValueError("data must be a list or a string")
    rows = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in data] if isinstance(data, list) else [data]
    return spark.createDataFrame(list(enumerate(rows)), "_seq long, value string")


def sql_query(spark: SparkSession, c: dict) -> DataFrame:
    config = SqlNodeConfig.from_config(c)
    return run_sql(spark, config.sql, config.parameters)


def table(spark: SparkSession, c: dict) -> DataFrame:
    """A table, or files of a columnar format."""
    return spark.table(c["table"]) if "table" in c else spark.read.format(c.get("format", "parquet")).load(c["path"])


def mysql_query(spark: SparkSession, c: dict) -> DataFrame:
    """A JDBC query; the server's driver must be on the class path."""
    url = c.get("url") or f"jdbc:mysql://{c['host']}:{c.get('port', 3306)}/{c['database']}"
    reader = spark.read.format("jdbc").option("url", url).option("query", c["sql"]).option("fetchsize", int(c.get("fetchSize", 1000)))
    for key in ("username", "password", "driver"):
        if key in c:
            reader = reader.option("user" if key == "username" else key, c[key])
    return embedded.load(reader.load()) if embedded.drivers_own(spark, url) else reader.load()


def kafka_consumer(spark: SparkSession, c: dict) -> DataFrame:
    """A topic as a stream; the connector must be on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", c["brokers"]).option("subscribe", c["topic"]).load().select(F.col("value").cast("string").alias("value"), "timestamp")


def jdbc_stream(spark: SparkSession, c: dict) -> DataFrame:
    """A table over JDBC in parallel parts by a whole-number column, as one does in place of a row stream."""
    options = {"url": c["url"], "dbtable": c["table"], "fetchsize": str(int(c.get("fetchSize", 1000)))}
    if c.get("partitionColumn"):
        options |= {"partitionColumn": c["partitionColumn"], "lowerBound": str(c["lower"]), "upperBound": str(c["upper"]), "numPartitions": str(c.get("partitions", 8))}
    for key in ("user", "password", "driver"):
        if key in c:
            options[key] = c[key]
    rows = spark.read.format("jdbc").options(**options).load()
    return embedded.load(rows) if embedded.drivers_own(spark, c["url"]) else rows


def single(spark: SparkSession, c: dict) -> DataFrame:
    """One record."""
    return spark.createDataFrame([(0, str(c.get("value", "")))], "_seq long, value string")


def repeated(spark: SparkSession, c: dict) -> DataFrame:
    """One record ``count`` times."""
    return spark.range(int(c.get("count", 1))).select(F.col("id").alias("_seq"), F.lit(str(c.get("value", ""))).alias("value"))


def change_ticks(spark: SparkSession, c: dict) -> DataFrame:
    """Simulated changes as a stream: the events of ``cdc.events`` by the ticks of the rate source, ``rowsPerSecond`` of them."""
    ticks = rate(spark, c).select((F.col("value") + 1).alias("id"))
    return ticks.select(*_change_columns(int(c.get("keys", 10))))


def rate(spark: SparkSession, c: dict) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", int(c.get("rowsPerSecond", 1))).load()


def directory_watch(spark: SparkSession, c: dict) -> DataFrame:
    """New files of a folder as a stream; a schema is needed, files a trigger are limited."""
    return spark.readStream.format(c.get("format", "csv")).schema(c["schema"]).option("maxFilesPerTrigger", int(c.get("maxFiles", 100))).load(c["path"])


def change_events(spark: SparkSession, c: dict) -> DataFrame:
    """Simulated changes of ``users`` and ``orders``: growing position, operation and images chosen by hash."""
    return spark.range(1, int(c.get("count", 100)) + 1).select(*_change_columns(int(c.get("keys", 10))))


def _change_columns(keys: int) -> list:
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    kind = F.element_at(F.array(*map(F.lit, ("INSERT", "UPDATE", "DELETE"))), (h(1, 3) + 1).cast("int"))
    image = F.create_map(F.lit("id"), (h(2, keys) + 1).cast("string"), F.lit("age"), (h(3, 60) + 18).cast("string"))
    return [
        F.concat(F.lit("evt-"), "id").alias("event_id"),
        F.when(h(4, 2) == 0, "users").otherwise("orders").alias("table_name"),
        kind.alias("event_type"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.when(kind != "INSERT", image).alias("before"),
        F.when(kind != "DELETE", image).alias("after"),
        F.col("id").alias("position"),
    ]


def snapshot(spark: SparkSession, c: dict) -> DataFrame:
    """The initial rows of ``users`` (100) or ``orders`` (200)."""
    if c.get("table", "users") == "users":
        return spark.range(1, 101).select("id", F.concat(F.lit("User"), "id").alias("name"), F.concat(F.lit("user"), "id", F.lit("@example.com")).alias("email"))
    return spark.range(1, 201).select("id", (F.col("id") % 100 + 1).alias("user_id"), F.concat(F.lit("Product"), "id").alias("product_name"))


SOURCES = {
    "random.numbers": random_numbers,
    "sequence.numbers": sequence_numbers,
    "file.text": file_text,
    "file.csv": file_csv,
    "memory.collection": memory_collection,
    "sql.query": sql_query,
    "table.scan": table,
    "mysql.query": mysql_query,
    "kafka.consumer": kafka_consumer,
    "rate.ticks": rate,
    "jdbc.table": jdbc_stream,
    "single": single,
    "repeat": repeated,
    "cdc.ticks": change_ticks,
    "directory.watch": directory_watch,
    "cdc.events": change_events,
    "cdc.snapshot": snapshot,
}
