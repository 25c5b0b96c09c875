"""Column expressions: the filter and map dialect, text helpers, the JVM string hash."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def jvm_trim(c: Column) -> Column:
    """Strip all characters up to U+0020 from both ends."""
    return F.regexp_replace(c, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


def jvm_hash(c: Column) -> Column:
    """The JVM's String.hashCode, as an int, over UTF-16 units."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    codes = F.transform(F.sequence(F.lit(0), F.greatest((F.length(units) / 4).cast("int"), F.lit(1)) - 1), lambda k: F.coalesce(F.conv(F.substr(units, k * 4 + 1, F.lit(4)), 16, 10).cast("long"), F.lit(0)))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: (acc * 31 + x) % (1 << 32))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")


def shard_of(c: Column, shards: int = 100) -> Column:
    """abs(hash) mod shards; the least int, whose abs is negative on the JVM, goes to a shard as well."""
    return (F.abs(jvm_hash(c).cast("long")) % shards).cast("int")


def filter_condition(text: str, value: Column) -> Column:
    """The filter dialect. The first ``>`` (else ``<``) compares the row's first comma field with the number right of it; what is left of it is ignored. Rows and thresholds that don't parse let the row pass; ``contains X`` is a substring test; other text passes all."""
    for sign in (">", "<"):
        if sign in text:
            parts = text.split(sign)
            if len(parts) != 2:
                return F.lit(False)
            try:
                limit = float(parts[1].strip())
            except ValueError:
                return F.lit(True)
            number = F.split(value, ",")[0].try_cast("double")
            test = (number > limit if sign == ">" else number < limit) & ~F.isnan(number)
            return F.coalesce(test, F.lit(True))
    if "contains" in text:
        return F.contains(value, F.lit(text.replace("contains", "").strip().replace("'", "").replace('"', "")))
    if text.startswith("expr:"):
        return F.expr(text[5:])
    return F.lit(True)


def map_expression(text: str, value: Column) -> Column:
    """The map dialect: toUpperCase, toLowerCase, trim, prefix:P, expr:E; other text changes nothing."""
    simple = {"toUpperCase": F.upper, "toLowerCase": F.lower, "trim": jvm_trim}
    if text in simple:
        return simple[text](value)
    if text.startswith("prefix:"):
        return F.concat(F.lit(text[7:]), value)
    return F.expr(text[5:]) if text.startswith("expr:") else value


def seconds(text: str) -> int:
    """Seconds of a duration such as 30s, 5m, 1h or 1d."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


def json_row(*cols: str) -> Column:
    """A row as compact JSON that keeps nulls."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def buckets(value: Column, limits: list[float], name: str = "le") -> list[Column]:
    """Cumulative histogram counts, one aggregate for each limit."""
    return [F.count_if(value <= x).alias(f"{name}_{str(x).replace('.', '_')}") for x in limits]
