"""Metrics over logs: histograms, rates, percentiles, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import buckets
from .ordered import at_index

#: Upper bounds of the standard histograms.
QUERY_SECONDS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]
POOL_WAIT_SECONDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0]
ROWS = [1, 10, 100, 1000, 10000, 100000, 1000000]
ROUTING_SECONDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
EXECUTION_SECONDS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]
HTTP_SECONDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]


def histogram(df: DataFrame, value: Column, limits: list[float], *keys: str) -> DataFrame:
    """Cumulative counts below each limit, with count and sum."""
    return df.groupBy(*keys).agg(*buckets(value, limits), F.count(value).alias("n"), F.sum(value).alias("total"))


def rate(good: Column, total: Column, empty: float) -> Column:
    """Percent of good ones; ``empty`` where there are none."""
    return F.when(total > 0, good * 100.0 / total).otherwise(empty)


def node_stats(df: DataFrame, duration: Column, rows: Column, ok: Column, *keys: str) -> DataFrame:
    n, good = F.count("*"), F.count_if(ok)
    return df.groupBy(*keys).agg(n.alias("executions"), F.sum(duration).alias("total_duration"), F.avg(duration).alias("avg_duration"), F.avg(rows).alias("avg_rows"), rate(good, n, 100.0).alias("success_rate"))


def indexed_percentiles(df: DataFrame, value: str, shares: list[float], key: str) -> DataFrame:
    """The value at 0-based index floor(n * p) of the sorted values of each key."""
    return at_index(df, key, value, shares)


def retry_stats(df: DataFrame, ok: Column, retried: Column, *keys: str) -> DataFrame:
    """Attempts by outcome, with the shares of good and of repeated ones in percent; 0 without attempts."""
    n, good, again = F.count("*"), F.count_if(ok), F.count_if(retried)
    return df.groupBy(*keys).agg(n.alias("total"), good.alias("successful"), F.count_if(~ok).alias("failed"), again.alias("retried"), rate(good, n, 0.0).alias("success_rate"), rate(again, n, 0.0).alias("retry_rate"))


def counts_by(df: DataFrame, *labels: str) -> DataFrame:
    """A counter: one row for each combination of labels."""
    return df.groupBy(*labels).agg(F.count("*").alias("value"))


def snapshot(df: DataFrame, status: Column, connection: Column) -> DataFrame:
    """One row: queries by status, connections by state, success rate in percent (100 without queries)."""
    good, bad = F.count_if(status == "success"), F.count_if(status == "error")
    return df.agg((good + bad).alias("query_total"), good.alias("query_success"), bad.alias("query_errors"), F.count_if(connection == "active").alias("active_connections"), F.count_if(connection == "idle").alias("idle_connections"),
                  F.count_if(connection.isin("active", "idle")).alias("total_connections"), rate(good, good + bad, 100.0).alias("success_rate"))


def shard_balance(df: DataFrame, shard: str, shards: int) -> DataFrame:
    """One row: mean and population deviation of the rows over all shards, empty ones too, and the share of shards in use."""
    counts = df.groupBy(shard).agg(F.count("*").alias("n"))
    mean = F.sum("n") / shards
    # Empty shards add mean squared each: the square sum is over those in use.
    return counts.agg(mean.alias("mean"), F.sqrt(F.sum(F.col("n") * F.col("n")) / shards - mean * mean).alias("stddev"), (F.count("*") / shards).alias("used"))


def throughput(rows: Column, millis: Column) -> Column:
    return F.when(millis > 0, rows * 1000.0 / millis).otherwise(0.0)


def latest_gauge(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, at).alias(value))


def counter(df: DataFrame, delta: str, *keys: str) -> DataFrame:
    """The value of increments less decrements."""
    return df.groupBy(*keys).agg(F.sum(delta).alias("value"))
