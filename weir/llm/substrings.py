"""Removal of long repeated word runs, by difference-cover anchors (op 9).

A word is removed if a window of ``window`` words that covers it also starts
in a document with a smaller doc_id. Hashing every window of the corpus would
move several times its size, so first only anchors are hashed: runs of
``window - period + 1`` words that begin at positions whose remainder modulo
``period`` lies in a difference cover. Two equal windows at any two offsets
share an anchor that is aligned in both. Anchors found in different texts are
then extended: every window around them is hashed and compared, which only
touches texts that share something.

Equal texts are told apart from shared runs by a text key: all but the copy
with the smallest doc_id lose every word (if they hold a window at all), and
only that copy takes part in the comparison.

Edge cases: null and empty texts have no words; texts shorter than the window
keep all; a row with a null doc_id is neither a source nor cut; rows that
repeat a doc_id count as one document; an empty table gives an empty result;
other columns are not read. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import WordHashes, batches_of, cut, docs_view, drop, mix, read, release_shuffles, slices

#: Perfect difference sets: every remainder is a difference of two members.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
PROFILE = "doc_id long, text_key binary, n_words long, sha256 string"


def period_for(window: int) -> int:
    """The largest period that leaves anchors of at least a third of the window."""
    return max((p for p in COVERS if window - p + 1 >= window / 3), default=7)


class Powers:
    """Powers of the base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (BASE, BASE_INV))
        return self.up[:n], self.down[:n]


def window_hashes(h: np.ndarray, size: int, powers: Powers, at: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``size`` words at the given positions."""
    up, down = powers.get(len(h))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up)))
    return mix((total[at + size] - total[at]) * down[at] + np.uint64(size))


def aligned(n: int, window: int, period: int) -> np.ndarray:
    """Anchor positions in a text of n words."""
    end = n - (window - period + 1)
    base = np.arange(0, end + 1, period)[:, None] + np.array(COVERS[period])
    at = base.ravel()
    return at[at <= end]


def anchors(window: int, period: int, with_place: bool):
    size = window - period + 1

    def run(batches):
        words, powers = WordHashes(), Powers()
        for b in slices(batches):
            hashes, keys, ids, places = [], [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                parts = t.split() if t else []
                if len(parts) < window:
                    continue
                words.trim()
                at = aligned(len(parts), window, period)
                hashes.append(window_hashes(words.of(parts), size, powers, at))
                if with_place:
                    ids.append(np.full(len(at), i))
                    places.append(at.astype(np.int32))
                else:
                    keys.append(np.full(len(at), xxhash.xxh3_64_intdigest(t), dtype=np.uint64))
            if not hashes:
                continue
            cols = [np.concatenate(hashes).view(np.int64)]
            cols += [np.concatenate(ids), np.concatenate(places)] if with_place else [np.concatenate(keys).view(np.int64)]
            names = ["anchor", "doc_id", "place"] if with_place else ["anchor", "text_key"]
            for k in range(0, len(cols[0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 18)]) for c in cols], names=names)

    return run


def windows_near(window: int, period: int):
    """All windows around the shared anchors of a text."""

    def run(batches):
        words, powers, reach = WordHashes(), Powers(), period - 1
        for b in slices(batches):
            for i, t, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "places"))):
                parts = t.split() if t else []
                n = len(parts) - window + 1
                if n < 1:
                    continue
                words.trim()
                p = np.array(places, dtype=np.int64)
                p = p[p < len(parts)]
                edge = np.zeros(len(parts) + 2, dtype=np.int32)
                np.add.at(edge, np.maximum(p - reach, 0), 1)
                np.add.at(edge, p + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                h = words.of(parts)
                one = window_hashes(h, window, powers, at).view(np.int64)
                two = (window_hashes(mix(h), window, powers, at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for k in range(0, len(at), 1 << 18):
                    s = slice(k, k + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(one[s]), pa.array(two[s]), pa.array(np.full(len(at[s]), i)), pa.array(at[s].astype(np.int32))], names=["h1", "h2", "doc_id", "place"])

    return run


def profile(batches):
    for b in slices(batches):
        keys, counts, digests = [], [], []
        for t in b.column("text"):
            t = t.as_py() or b""
            parts = t.split()
            keys.append(xxhash.xxh3_128_digest(t))
            counts.append(len(parts))
            digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "text_key", "n_words", "sha256"])


def cut_words(text: bytes | None, starts, window: int) -> tuple[list[bytes], int]:
    """The words that no window at the given starts covers, and how many go."""
    parts = text.split() if text else []
    edge = np.zeros(len(parts) + 1, dtype=np.int32)
    s = np.array([x for x in set(starts) if x + window <= len(parts)], dtype=np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + window, -1)
    keep = np.flatnonzero(np.cumsum(edge)[: len(parts)] == 0)
    return [parts[k] for k in keep], len(parts) - len(keep)


class Repeats:
    """What ``find_repeats`` found. rows: every row with its text key and, for later copies of a text, ``copy``; touched: (doc_id, text, starts) of the other texts that lose words."""

    def __init__(self, rows: DataFrame, touched: DataFrame, window: int):
        self.rows, self.touched, self.window = rows, touched, window


def find_repeats(docs: DataFrame, window: int = 50) -> Repeats:
    spark, period = docs.sparkSession, period_for(window)
    texts = docs_view(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    named = texts.filter(F.col("doc_id").isNotNull())
    rows = cut(texts.mapInArrow(profile, PROFILE), "substring-rows")
    first = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    # An anchor of two texts at least; partial aggregation leaves a row for each task that holds a frequent one.
    shared = named.mapInArrow(anchors(window, period, False), "anchor long, text_key long").groupBy("anchor").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).filter("lo < hi").select("anchor")
    shared = cut(shared, "substring-shared")
    release_shuffles(spark)
    places = named.mapInArrow(anchors(window, period, True), "anchor long, doc_id long, place int").join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    places = cut(places.join(first.select("doc_id"), "doc_id", "left_semi"), "substring-places")
    drop(shared)
    release_shuffles(spark)
    near = cut(named.join(places, "doc_id"), "substring-near")
    drop(places)
    release_shuffles(spark)
    windows = near.mapInArrow(windows_near(window, period), "h1 long, h2 int, doc_id long, place int")
    origin = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last")).filter("origin < last")
    # Written, so that the join deals plain rows and Spark can split those of a passage that very many documents share.
    origin = cut(origin.select("h1", "h2", "origin"), "substring-origin")
    starts = windows.join(origin, ["h1", "h2"]).filter("doc_id > origin").groupBy("doc_id").agg(F.collect_set("place").alias("starts"))
    touched = cut(near.drop("places").join(starts, "doc_id"), "substring-touched")
    drop(near, origin)
    release_shuffles(spark)
    rows_first = rows.join(first.withColumnRenamed("doc_id", "first_id"), "text_key", "left")
    rows_first = rows_first.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    return Repeats(rows_first, touched, window)


def removed_counts(found: Repeats) -> DataFrame:
    """Per row: n_words, n_removed and the digest of the kept words."""
    window = found.window

    def each(batches):
        for b in slices(batches):
            gone, kept = [], []
            for t, s in zip(b.column("text"), b.column("starts")):
                left, n = cut_words(t.as_py(), s.as_py(), window)
                gone.append(n)
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "gone", "kept"])

    part = found.touched.dropDuplicates(["doc_id"]).mapInArrow(each, "doc_id long, gone long, kept string")
    none = hashlib.sha256(b"").hexdigest()
    return found.rows.join(part, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(none)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """The documents without the repeated runs; texts that lose words keep the rest joined by one space, texts that lose all go. Texts without a repeat stay byte for byte."""
    found = find_repeats(docs, window)

    @F.pandas_udf(StringType())
    def rest(texts, starts):
        import pandas as pd

        return pd.Series([t if s is None else b" ".join(cut_words((t or "").encode("utf-8", "surrogatepass"), s, window)[0]).decode("utf-8", "surrogatepass") for t, s in zip(texts, starts)])

    copies = found.rows.filter("copy").select(F.col("doc_id").alias("__weir_id"), F.array().cast("array<int>").alias("__weir_starts"), F.lit(True).alias("__weir_copy")).dropDuplicates(["__weir_id"])
    cuts = found.touched.select(F.col("doc_id").alias("__weir_id"), F.col("starts").alias("__weir_starts"), F.lit(False).alias("__weir_copy")).dropDuplicates(["__weir_id"])
    plan = copies.unionByName(cuts)
    out = docs.join(plan, docs["doc_id"] == plan["__weir_id"], "left").filter("__weir_copy is null or not __weir_copy")
    out = out.withColumn(text, rest(F.col(text), F.col("__weir_starts")))
    return out.filter(F.col("__weir_starts").isNull() | (F.length(text) > 0)).select(*docs.columns)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_counts(find_repeats(read(spark, sf_dir, "documents")))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
