"""Benchmark decontamination over a distributed positional inverted index (op 1).

``build_index`` cuts the documents into blocks of bounded size and stores, for
each block, every term with its positions (delta and variable-byte coded), and
one row that names the block's documents. No word leaves its block, so the
index is built without an exchange. ``search`` takes all test windows in one
pass, as a table: it sums their terms' frequencies over the index, orders each
window's words from the rarest on, and joins windows to blocks by the rarest
word, so a block sees only windows whose rarest word it holds. With the
block's postings of the windows' terms it intersects, for each such window,
the offset-adjusted position lists from the rarest term on; most end at the
first list. A gap between documents in the block's position space keeps
matches inside a document: phrases and, up to the ``reach`` the index was
built for, words near each other.

Words are runs of the bytes outside ``\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F`` after
A-Z became a-z. A window is ``window`` consecutive item words; an item with
fewer, but at least one, is one window.

Edge cases: a null or empty text has no words and is clean; an item without
words is never found; items with a null id are found as ``null``; repeated
items count once by id; repeated rows each get a row; a null doc_id is kept;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, docs_view, list_column, read

#: Separators become spaces and A-Z become a-z; bytes of non-ASCII characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "block long, term binary, n long, postings binary, doc_ids array<long>, lengths array<int>"
HITS = "block long, slot int, doc_id long, n_words long, hits array<int>, items array<string>"
WINDOWS = "words array<binary>, item string"
#: Text bytes of a block, windows' terms up to which they are broadcast.
BLOCK_BYTES, BROADCAST_TERMS = 8 << 20, 500_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def put_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte code of values below 2**35, and the bytes each takes."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for k in (7, 14, 21, 28):
        size += v >= np.uint64(1 << k)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(v) else 0, dtype=np.uint8)
    start = end - size
    for k in range(5):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        more = (size[at] > k + 1).astype(np.uint8) << 7
        out[start[at] + k] = ((v[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, size


def get_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(b < 128)
    start = np.concatenate(([0], last[:-1] + 1)) if len(last) else np.empty(0, dtype=np.int64)
    k = np.arange(len(b)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * k), start) if len(last) else np.empty(0, dtype=np.int64)


def segment(block: int, ids: list, texts: list[list[bytes]], gap: int) -> pa.RecordBatch:
    """The rows of a block: its documents, then each term's postings."""
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    base = np.cumsum(lengths + gap) - (lengths + gap)
    names: dict[bytes, int] = {}
    term = np.fromiter((names.setdefault(w, len(names)) for ws in texts for w in ws), dtype=np.int32, count=int(lengths.sum()))
    pos = np.arange(len(term)) + np.repeat(np.arange(len(texts)) * gap, lengths)
    order = np.argsort(term, kind="stable")
    term, pos = term[order], pos[order]
    first = np.flatnonzero(np.diff(term, prepend=-1)) if len(term) else np.empty(0, dtype=np.int64)
    delta = np.diff(pos, prepend=0)
    delta[first] = pos[first]
    data, size = put_varints(delta)
    n = len(first)
    cuts = np.concatenate(([0], np.cumsum(np.add.reduceat(size, first)) if n else np.empty(0, dtype=np.int64))).astype(np.int32)
    # The first row holds no posting: its offsets are 0 and 0.
    postings = pa.Array.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(np.concatenate(([0], cuts)).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    none64, none32 = [None] * n, [None] * n
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, block)),
            pa.array([None, *names], type=pa.binary()),
            pa.array(np.concatenate(([len(texts)], np.diff(np.append(first, len(term)))))),
            postings,
            pa.array([ids, *none64], type=pa.list_(pa.int64())),
            pa.array([lengths.tolist(), *none32], type=pa.list_(pa.int32())),
        ],
        names=[c.split()[0] for c in INDEX.split(", ")],
    )


def build_index(docs: DataFrame, window: int, block_bytes: int = BLOCK_BYTES, reach: int = 0) -> DataFrame:
    """The positional index of all documents, as a written table; for phrases of ``window`` words and words at most ``reach`` apart."""
    gap = max(window, reach) + 1

    def run(batches):
        from pyspark import TaskContext

        part, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                t = t or b""
                ids.append(i)
                texts.append(words_of(t))
                size += len(t) + 8
                if size >= block_bytes:
                    yield segment(part << 32 | seq, ids, texts, gap)
                    seq, ids, texts, size = seq + 1, [], [], 0
        if ids:
            yield segment(part << 32 | seq, ids, texts, gap)

    out = cut(docs_view(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX), "postings")
    out._weir_gap = gap
    return out


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(words, items): the distinct windows of all items, each with the ids that have it."""

    def run(batches):
        for b in batches:
            for i, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                words = words_of(t or b"")
                starts = range(max(1, len(words) - window + 1)) if words else range(0)
                for k in range(0, len(starts), 10_000):
                    some = [words[s : s + window] for s in starts[k : k + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.binary())), pa.array([i] * len(some), pa.string())], names=["words", "item"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, WINDOWS).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def planned(index: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The windows whose words all occur, with their words' places from the rarest on; and the index's postings of their terms."""
    windows = cut(item_windows(items, window).withColumn("win", F.monotonically_increasing_id()), "windows")
    terms = cut(windows.select(F.explode("words").alias("term")).distinct(), "window-terms")
    want = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    freq = cut(index.select("term", "n").join(want, "term").groupBy("term").agg(F.sum("n").alias("freq")), "window-freq")
    places = windows.select("win", F.posexplode("words").alias("at", "term")).join(freq, "term")
    order = places.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("freq", "at"))).alias("order"))
    plan = windows.join(order, "win").filter(F.size("order") == F.size("words"))
    plan = plan.select("words", F.col("order.at").alias("order"), "items", F.get("words", F.col("order")[0]["at"]).alias("term"))
    return cut(plan, "window-plan"), index.join(want, "term", "left_semi")


def phrase(lists: dict, words: list, order: list[int]) -> np.ndarray:
    """Starts of the phrase: offset-adjusted lists, met from the rarest word on."""
    at = None
    for k in order:
        p = lists.get(words[k])
        if p is None:
            return np.empty(0, dtype=np.int64)
        if at is None:
            at = p - k
        else:
            i = np.minimum(np.searchsorted(p, at + k), len(p) - 1)
            at = at[p[i] == at + k]
        if not len(at):
            break
    return at


def near(lists: dict, words: list, order: list[int], slop: int) -> np.ndarray:
    """Places of the rarest word that have every other word within ``slop`` words of it."""
    p = lists.get(words[order[0]])
    if p is None:
        return np.empty(0, dtype=np.int64)
    at = p
    for k in order[1:]:
        p = lists.get(words[k])
        if p is None or not len(at):
            return np.empty(0, dtype=np.int64)
        i = np.searchsorted(p, at)
        left, right = p[np.maximum(i - 1, 0)], p[np.minimum(i, len(p) - 1)]
        at = at[np.minimum(np.abs(at - left), np.abs(right - at)) <= slop]
    return at


def search(index: DataFrame, items: DataFrame, window: int, slop: int | None = None) -> DataFrame:
    """Per document: the words hit and the items found; exact phrases, or with ``slop`` windows whose words all lie within so many words of their rarest one."""
    gap = index._weir_gap
    if max(window, slop or 0) >= gap:
        raise ValueError(f"the index was built for a reach of {gap - 1} words")
    plan, postings = planned(index, items, window)
    mine = index.select(F.col("block").alias("at"), "term").join(plan, "term").select("at", "words", "order", "items")
    lookup = postings.unionByName(index.filter(F.col("term").isNull()))
    return lookup.groupBy("block").cogroup(mine.groupBy("at")).applyInArrow(_matcher(gap, slop), HITS)


def _matcher(gap: int, slop: int | None):
    def run(table: pa.Table, windows: pa.Table) -> pa.Table:
        lists, ids, lengths = {}, [], []
        for t, p, d, n in zip(*(table.column(c).to_pylist() for c in ("term", "postings", "doc_ids", "lengths"))):
            if t is None:
                ids, lengths = d, n
            else:
                lists[t] = np.cumsum(get_varints(p))
        size = np.array(lengths, dtype=np.int64)
        base = np.cumsum(size + gap) - (size + gap)
        hits, items = defaultdict(list), defaultdict(set)
        for chunk in windows.to_batches(max_chunksize=1_000):
            for words, order, names in zip(*(chunk.column(c).to_pylist() for c in ("words", "order", "items"))):
                at = phrase(lists, words, order) if slop is None else near(lists, words, order, slop)
                if not len(at):
                    continue
                span = np.arange(len(words)) if slop is None else np.zeros(1, dtype=np.int64)
                for slot in np.unique(doc := np.searchsorted(base, at, side="right") - 1):
                    hits[slot].append((at[doc == slot][:, None] + span - base[slot]).ravel())
                    items[slot].update(names)
        none = np.empty(0, dtype=np.int64)
        found = [np.unique(np.concatenate(hits[s])) if s in hits else none for s in range(len(ids))]
        return pa.table(
            [
                pa.array(np.full(len(ids), table.column("block")[0].as_py())),
                pa.array(np.arange(len(ids), dtype=np.int32)),
                pa.array(ids, type=pa.int64()),
                pa.array(size),
                list_column(found, pa.int32()),
                pa.array([sorted(items[s]) if s in items else [] for s in range(len(ids))], type=pa.list_(pa.string())),
            ],
            names=[c.split()[0] for c in HITS.split(", ")],
        )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row: its words, the words inside any occurrence of a benchmark window, and the items found."""
    found = search(build_index(docs, window), benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "items",
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


QUERIES = {"op1_decontaminate": op1_decontaminate}
