"""Quality rules with cross-document line frequency (op 7).

One Arrow pass measures every text and hashes its normalised lines (lower
case, single spaces) together with the host (``source``). A line is frequent
when more distinct documents of its host hold it than ``max_share`` of the
host's documents, and more than ``least`` in any case; copies of one text
count, rows of one doc_id count once, each row without one counts.
``remove_frequent_lines`` takes frequent lines out of the texts; a document
that loses more than ``max_removed`` of its words is depleted and rejected.

Edge cases: a null or empty text has no words and fails the base rules; a null
source is a host of its own; a null doc_id is kept as a row; repeated rows
each get a row; an empty table gives an empty result; other columns are not
read, and ``remove_frequent_lines`` passes them on.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, docs_view, list_column, mix, read, to_signed

SYMBOLS = "#*$%&|<>"
#: A line is frequent in a host if more than this share of its documents, and more than so many, hold it.
MAX_SHARE, LEAST = 0.01, 10
SPACES = " \t\n\x0b\x0c\r"
PROFILE = "doc_id long, text_key long, host_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_keys array<long>, line_words array<int>"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n + 2).view(np.uint64)
    w = mix(h[:-2]) * np.uint64(3) + mix(h[1:-1] + np.uint64(1)) * np.uint64(5) + mix(h[2:] + np.uint64(2)) * np.uint64(7)
    order = np.argsort(w)
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(n + 3, dtype=np.int32)
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(starts, at, 1)
    np.add.at(starts, at + 3, -1)
    return int((np.cumsum(starts)[: n + 2] > 0).sum())


def host_name(host: str | None) -> bytes:
    return b"\1" if host is None else b"\2" + host.encode("utf-8", "surrogatepass")


def line_key(host: bytes, parts: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(host + b"\0" + b" ".join(parts))


def line_stats(host: bytes, text: str) -> tuple[int, list[int], list[int]]:
    """Repeated lines; then a key of each distinct normalised line of the host, and the words it holds here."""
    seen: set[str] = set()
    dup, words = 0, defaultdict(int)
    for line in text.split("\n"):
        parts = line.encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        words[line_key(host, parts)] += len(parts)
    return dup, list(words), list(words.values())


def profile(batches):
    for b in batches:
        ids, same, texts, hosts = b.column("doc_id"), b.column("text_key"), b.column("text").to_pylist(), b.column("host").to_pylist()
        num = np.zeros((5, len(texts)), dtype=np.int64)
        keys, counts = [], []
        for i, (t, host) in enumerate(zip(texts, hosts)):
            t = t or ""
            raw = t.encode("utf-8", "surrogatepass")
            words = raw.split()
            dup, k, c = line_stats(host_name(host), t)
            num[:, i] = (len(words), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), dup, repeat_words(words))
            keys.append(to_signed(k))
            counts.append(np.array(c, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([ids, same, pa.array([xxhash.xxh3_64_intdigest(host_name(h)) >> 1 for h in hosts], pa.int64()), *map(pa.array, num), list_column(keys, pa.int64()), list_column(counts, pa.int32())], names=[c.split()[0] for c in PROFILE.split(", ")])


def profiled(docs: DataFrame, host: str) -> DataFrame:
    """The written profile of every row, with a number of its own (``uid``)."""
    rows = docs_view(docs, F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col(host).cast("string").alias("host")).mapInArrow(profile, PROFILE)
    return cut(rows.withColumn("uid", F.monotonically_increasing_id()), "quality-profile")


def frequent_lines(rows: DataFrame, max_share: float, least: int) -> DataFrame:
    """Keys of the lines that too many documents of their host hold."""
    one = F.when(F.col("doc_id").isNull(), F.col("uid")).alias("row")
    # Distinct (line, document) pairs, then counts combined before their exchange: a line that a third of all documents share is a few rows there.
    lines = rows.select("doc_id", one, "host_key", F.explode("line_keys").alias("key")).distinct()
    often = lines.groupBy("host_key", "key").count().filter(F.col("count") > least)
    sizes = rows.select("doc_id", one, "host_key").distinct().groupBy("host_key").agg(F.count("*").alias("documents"))
    return often.join(sizes, "host_key").filter(F.col("count") > max_share * F.col("documents")).select("key")


def judged(rows: DataFrame, frequent: DataFrame, max_removed: float, min_words: int, max_repeat: float) -> DataFrame:
    """The profile with n_frequent_words, frequent keys, base_failed and depleted."""
    removed = (
        rows.select("uid", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l"))
        .select("uid", F.col("l.line_keys").alias("key"), F.col("l.line_words").alias("words"))
        .join(frequent, "key")
        .groupBy("uid")
        .agg(F.sum("words").cast("long").alias("n_frequent_words"), F.collect_list("key").alias("frequent"))
    )
    out = rows.drop("line_keys", "line_words").join(removed, "uid", "left").fillna(0, ["n_frequent_words"])
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = (F.col("n_frequent_words") > max_removed * F.col("n_words")) & (F.col("n_words") > 0)
    return out.withColumn("base_failed", failed).withColumn("depleted", depleted)


def quality_rules(docs: DataFrame, host: str = "source", max_share: float = MAX_SHARE, least: int = LEAST, max_removed: float = 0.5, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """Per row: the base measures, words on frequent lines, base_failed, depleted and kept."""
    rows = profiled(docs, host)
    out = judged(rows, frequent_lines(rows, max_share, least), max_removed, min_words, max_repeat)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"), "n_frequent_words", "depleted")


def remove_frequent_lines(docs: DataFrame, host: str = "source", max_share: float = MAX_SHARE, least: int = LEAST, max_removed: float = 0.5, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """The rows that ``quality_rules`` keeps, their texts without the frequent lines."""
    rows = profiled(docs, host)
    good = judged(rows, frequent_lines(rows, max_share, least), max_removed, min_words, max_repeat).filter("not base_failed and not depleted")
    # Rows of one doc_id, host and text have one verdict.
    good = cut(good.groupBy("doc_id", "text_key", "host_key").agg(F.first("frequent").alias("frequent")), "quality-good")

    @F.pandas_udf("string")
    def without(texts: pd.Series, hosts: pd.Series, keys: pd.Series) -> pd.Series:
        def strip(text, host, keys):
            if keys is None or not len(keys):
                return text
            gone, host = {int(k) & (1 << 64) - 1 for k in keys}, host_name(host)
            lines = [(x, x.encode("utf-8", "surrogatepass").lower().split()) for x in text.split("\n")]
            return "\n".join(x for x, parts in lines if not parts or line_key(host, parts) not in gone)

        return pd.Series([strip(t, h, k) for t, h, k in zip(texts, hosts, keys)], dtype=object)

    @F.pandas_udf("long")
    def host_of(hosts: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh3_64_intdigest(host_name(h)) >> 1 for h in hosts], dtype="int64")

    text, of = F.col("text").cast("string"), F.col(host).cast("string")
    mine = docs.withColumns({"__weir_text": F.xxhash64(text), "__weir_host": host_of(of)})
    found = good.select(F.col("doc_id").alias("__weir_id"), F.col("text_key").alias("__weir_key"), F.col("host_key").alias("__weir_of"), F.col("frequent").alias("__weir_gone"))
    both = mine.join(found, mine["doc_id"].cast("long").eqNullSafe(found["__weir_id"]) & (mine["__weir_text"] == found["__weir_key"]) & (mine["__weir_host"] == found["__weir_of"]))
    return both.withColumn("text", without(text, of, F.col("__weir_gone"))).select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
