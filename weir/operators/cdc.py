"""Change data capture: position gate, latest images, progress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import positions, running_max

MAX_POSITION = (1 << 63) - 1


@dataclass
class Watermarks:
    """low, current and high positions of a table's synchronisation."""

    low: int = 0
    high: int = MAX_POSITION
    current: int = 0

    @classmethod
    def start(cls, low: int = 0, high: int = MAX_POSITION) -> "Watermarks":
        return cls(low, high, low)

    def accepts(self, position: int) -> bool:
        return self.current < position <= self.high

    def advance_high(self, to: int) -> None:
        self.high = max(self.high, to)

    def control(self, name: str, value: int) -> None:
        """A control event: ``high`` only grows, ``low`` and ``current`` are set, others are ignored."""
        if name == "high":
            self.advance_high(value)
        elif name in ("low", "current"):
            setattr(self, name, value)

    def reset(self) -> None:
        self.low, self.high, self.current = 0, MAX_POSITION, 0


def in_range(position: Column, current: int, high: int = MAX_POSITION) -> Column:
    return (position > current) & (position <= high)


def accepted(events: DataFrame, table: str | None, key: str, arrival: str, position: str, current: int = 0, high: int = MAX_POSITION) -> DataFrame:
    """Events the gate lets through in order of arrival: each moves the mark to its position. ``key`` partitions the order (a table's events are one order)."""
    rows = events.filter(F.col("table_name") == table) if table else events
    rows = running_max(rows.filter(F.col(position) <= high), [key], arrival, position, "__before")
    return rows.filter(F.col(position) > F.greatest(F.lit(current).cast("long"), F.coalesce("__before", F.lit(current).cast("long")))).drop("__before")


def latest(events: DataFrame, key: str, position: str, kind: str, delete: str, *cols: str, arrival: str | None = None) -> DataFrame:
    """The last image of each key, of equal positions the one that arrived last; keys whose last event is a delete go. Partial aggregation, no sort."""
    order = F.struct(position, arrival) if arrival else F.col(position)
    last = events.groupBy(key).agg(F.max_by(F.struct(position, kind, *cols), order).alias("l"))
    return last.filter(F.col(f"l.{kind}") != delete).select(key, f"l.{position}", *[f"l.{c}" for c in cols])


def apply_changes(target: DataFrame, changes: DataFrame, key: str, position: str, kind: str, delete: str) -> DataFrame:
    """Target rows with the changes' last images merged in; the target has the key and the images' columns."""
    cols = [c for c in target.columns if c != key]
    new = changes.groupBy(key).agg(F.max_by(F.struct(kind, *cols), position).alias("l"))
    kept = target.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.filter(F.col(f"l.{kind}") != delete).select(key, *[f"l.{c}" for c in cols]))


def progress(current: Column, low: Column, high: Column) -> Column:
    """Percent done, cut to a whole number; 0 for an empty span."""
    return F.when(high > low, ((current - low) * 100.0 / (high - low)).cast("int")).otherwise(0)


def control_marks(events: DataFrame, source: str, mark: str, seq: str, start: Watermarks) -> DataFrame:
    """One row (low, current, high) after all control events in order: ``high`` only grows, ``low`` and ``current`` take their last value, others count for nothing."""
    last = lambda name, was: F.coalesce(F.max_by(F.when(F.col(source) == name, F.col(mark)), F.when(F.col(source) == name, F.col(seq))), F.lit(was)).alias(name)
    high = F.greatest(F.lit(start.high), F.coalesce(F.max(F.when(F.col(source) == "high", F.col(mark))), F.lit(start.high))).alias("high")
    return events.agg(last("low", start.low), last("current", start.current), high)


def full_sync(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Batches of a full copy in order of a whole-number key: number, rows, first and last key; ``current`` after a batch is its last key."""
    numbered = positions(rows.select(key), key).withColumn("batch", F.floor(F.col("_pos") / size))
    return numbered.groupBy("batch").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("current"))


def counters(events: DataFrame, position: str, ok: Column) -> DataFrame:
    return events.agg(F.count("*").alias("processed"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("errors"), F.max(position).alias("last_position"))
