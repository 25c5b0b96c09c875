"""Order over a whole table without putting it into one task: ranges with fixed bounds, totals of ranges, then rows of a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges an order is cut into at most, and error of the bounds' quantiles.
RANGES, ERROR = 200, 0.002


def range_of(df: DataFrame, order: str, ranges: int | None = None) -> Column:
    """The number of a row's range of ``order`` (a number). The bounds are literals, so every evaluation gives the same; nulls are in range 0."""
    n = ranges or min(RANGES, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = sorted(set(df.approxQuantile(order, [k / n for k in range(1, n)], ERROR))) if n > 1 else []
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))), F.lit(0))


def positions(df: DataFrame, order: str, name: str = "_pos") -> DataFrame:
    """Gapless positions 0, 1, ... by ``order`` (a number, nulls first); a range's rows are ranked, its offset comes from the ranges' counts."""
    rows = df.withColumn("__range", range_of(df, order))
    before = F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    # As many rows as there are ranges.
    sizes = rows.groupBy("__range").count().select(F.col("__range"), F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(order).asc_nulls_first())) - 1
    return rows.join(F.broadcast(sizes), "__range").withColumn(name, (F.col("__before") + rank).cast("long")).drop("__range", "__before")


def zip_rows(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows paired by position, as many as the shorter side has."""
    return positions(left, left_order).join(positions(right, right_order), "_pos")


def running_max(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The greatest value of the rows before each row of a key; null for the first. A key's rows lie in several tasks, by range of ``order``."""
    rows = df.withColumn("__range", range_of(df, order))
    by = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as keys times ranges that hold some.
    tops = rows.groupBy(*keys, "__range").agg(F.max(value).alias("__top")).withColumn("__earlier", F.max("__top").over(by)).drop("__top")
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(tops, [*keys, "__range"]).withColumn(name, F.greatest("__earlier", F.max(value).over(inside))).drop("__range", "__earlier")


def at_index(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """For each key the values at 0-based index floor(n * share) of its sorted values. Only the ranges that hold an asked index are sorted."""
    rows = df.select(key, value).filter(F.col(value).isNotNull()).withColumn("__range", range_of(df, value))
    counts = rows.groupBy(key, "__range").count()
    whole, before = Window.partitionBy(key), Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("n", F.sum("count").over(whole)).withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    asked = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.floor(F.col("n") * p).alias("at")) for p in shares]))
    asked = counts.select(key, "__range", "count", "before", asked.alias("a")).filter("a.at >= before and a.at < before + count")
    asked = asked.groupBy(key, "__range").agg(F.collect_list(F.struct(F.col("a.p").alias("p"), (F.col("a.at") - F.col("before") + 1).alias("r"))).alias("asked"))
    ranked = rows.join(asked, [key, "__range"]).withColumn("r", F.row_number().over(Window.partitionBy(key, "__range").orderBy(value)))
    found = ranked.select(key, value, "r", F.explode("asked").alias("a")).filter("r = a.r")
    return found.groupBy(key).agg(*[F.max(F.when(F.col("a.p") == float(p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares])
