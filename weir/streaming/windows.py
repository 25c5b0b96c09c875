"""Windows over event time, in batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, at: str, lateness: str | None) -> DataFrame:
    """Event time as a TIMESTAMP, with a watermark where one is asked for."""
    df = df.withColumn(at, F.col(at).cast("timestamp"))
    return df.withWatermark(at, lateness) if lateness else df


def tumbling(df: DataFrame, at: str, length: str, keys: list[str], aggs: list, lateness: str | None = None) -> DataFrame:
    return _spread(_late(df, at, lateness).groupBy(F.window(at, length).alias("w"), *keys).agg(*aggs), "w")


def hopping(df: DataFrame, at: str, length: str, slide: str, keys: list[str], aggs: list, lateness: str | None = None) -> DataFrame:
    return _spread(_late(df, at, lateness).groupBy(F.window(at, length, slide).alias("w"), *keys).agg(*aggs), "w")


def session(df: DataFrame, at: str, gap: str, keys: list[str], aggs: list, lateness: str | None = None) -> DataFrame:
    """An event a whole gap after the last opens a new session."""
    return _spread(_late(df, at, lateness).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*aggs), "w")


def _spread(df: DataFrame, w: str) -> DataFrame:
    rest = [c for c in df.columns if c != w]
    return df.select(F.col(f"{w}.start").cast("timestamp_ntz").alias("window_start"), F.col(f"{w}.end").cast("timestamp_ntz").alias("window_end"), *rest)


def within(df: DataFrame, at: str, length: str, lateness: str, keys: list[str]) -> DataFrame:
    """Distinct keys, remembered for the watermark only."""
    return _late(df, at, lateness).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, length: str, lateness: str) -> DataFrame:
    """Pairs of one key whose right row comes at the left one's time or less than ``length`` after it; in streams, state is kept for that span and the lateness. The right side's columns get the prefix ``other_``."""
    a = _late(left, at, lateness)
    b = _late(right, at, lateness).select(*[F.col(c).alias(f"other_{c}") for c in right.columns])
    near = (F.col(key) == F.col(f"other_{key}")) & (F.col(f"other_{at}") >= F.col(at)) & (F.col(f"other_{at}") < F.col(at) + F.expr(f"interval {length}"))
    return a.join(b, near)
