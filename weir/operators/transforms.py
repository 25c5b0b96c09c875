"""Transform nodes: each builder takes (spark, config, input) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import SqlNodeConfig, run_sql
from ..functions.exprs import filter_condition, jvm_trim, map_expression


def filter_rows(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    return df.filter(filter_condition(c.get("condition", ""), F.col("value") if "value" in df.columns else F.lit(None).cast("string")))


def map_rows(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    return df.withColumn("value", map_expression(c.get("expression", ""), F.col("value")))


def distinct(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    """The first row of each value; without a ``_seq`` any of them. Streams keep values within the watermark."""
    keys = [k for k in df.columns if k != "_seq"]
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark(keys) if c.get("watermark") else df.dropDuplicates(keys)
    if "_seq" not in df.columns:
        return df.dropDuplicates(keys)
    return df.groupBy(*keys).agg(F.min("_seq").alias("_seq")).select(*df.columns)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first whole row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def batch(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    """Rows unchanged, with the number of their batch where they have a ``_seq``."""
    size = int(c.get("batchSize", 100))
    if size <= 0:
        raise ValueError("batchSize must be positive")
    return df.withColumn("_batch", F.floor(F.col("_seq") / size)) if "_seq" in df.columns else df


def clean(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    """Trim strings and drop rows with nulls, as asked."""
    if c.get("trim", True):
        df = df.withColumns({n: jvm_trim(F.col(n)) for n, t in df.dtypes if t == "string"})
    return df.na.drop() if c.get("removeNull", True) else df


def transform(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    """New columns from SQL expressions, then a selection."""
    df = df.withColumns({n: F.expr(e) for n, e in (c.get("columns") or {}).items()})
    return df.select(*c["select"]) if c.get("select") else df


def aggregate_sum(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    field = c.get("field", "value")
    return df.groupBy(*c.get("groupBy", [])).agg(F.sum(F.col(field).try_cast("double")).alias(f"sum_{field}"))


def aggregate_count(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    return df.groupBy(*c.get("groupBy", [])).agg(F.count("*").alias("count"))


def sql_node(spark: SparkSession, c: dict, df: DataFrame, **views: DataFrame) -> DataFrame:
    """A statement over the view ``input`` (and others by name), run once over all rows."""
    config = SqlNodeConfig.from_config(c)
    return run_sql(spark, config.sql, config.parameters, **views, input=df)


def csv_clean(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    """Raw lines of id, name, age, email: without the header (the first by ``_seq``), at least four fields, names trimmed, emails in lower case, ages above 0 and below 150; lines that don't parse go."""
    first = df.agg(F.min("_seq")).first()[0]
    f = F.split("value", ",")
    rows = df.filter(F.col("_seq") != first).filter(F.size(f) >= 4)
    rows = rows.select("_seq", f[0].try_cast("int").alias("id"), jvm_trim(f[1]).alias("name"), f[2].try_cast("int").alias("age"), F.lower(f[3]).alias("email"))
    return rows.filter("id is not null and age > 0 and age < 150")


def drop_first(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    """Without the first ``n`` rows by ``_seq``: only those n are sorted out, the rest stays where it is."""
    n = int(c.get("n", 1))
    gone = df.select("_seq").orderBy("_seq").limit(n)
    return df.join(gone, "_seq", "left_anti")


def map_concat(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    """A row for each part of ``value`` (cut at ``separator``), in order."""
    parts = F.split("value", F.concat(F.lit("\\Q"), F.lit(c.get("separator", ",")), F.lit("\\E")))
    keep = [x for x in df.columns if x != "value"]
    return df.select(*keep, F.posexplode(parts).alias("_part", "value"))


def grouped(spark: SparkSession, c: dict, df: DataFrame) -> DataFrame:
    """One row for each ``size`` rows by ``_seq``: their values as a list, in order."""
    return batch(spark, {"batchSize": c.get("size", 10)}, df).groupBy("_batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "value"))), lambda x: x["value"]).alias("values"))


def prioritised(frames: list[DataFrame]) -> DataFrame:
    """One frame of all, with the rank of the one a row comes from: to be worked through in that order."""
    out = None
    for k, df in enumerate(frames):
        one = df.withColumn("_priority", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def balanced(df: DataFrame, workers: int, key: str) -> DataFrame:
    """The worker each row goes to, even and always the same."""
    return df.withColumn("_worker", F.pmod(F.xxhash64(key), F.lit(workers)).cast("int"))


def moving_sum(df: DataFrame, value: str, order: list, keys: list[str], size: int) -> DataFrame:
    """Sums of the last ``size`` rows of a key, full frames only."""
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(1 - size, 0)
    return df.withColumn("moving_sum", F.sum(value).over(frame)).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") >= size).drop("__n")


TRANSFORMS = {
    "filter": filter_rows,
    "filter.condition": filter_rows,
    "map": map_rows,
    "map.transform": map_rows,
    "distinct": distinct,
    "batch": batch,
    "data.clean": clean,
    "data.transform": transform,
    "aggregate.sum": aggregate_sum,
    "aggregate.count": aggregate_count,
    "sql.query": sql_node,
    "csv.clean": csv_clean,
    "drop": drop_first,
    "map.concat": map_concat,
    "grouped": grouped,
}
