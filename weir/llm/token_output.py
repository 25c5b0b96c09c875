"""Token ids as a Huffman-coded file (op 8).

Texts are dealt out by ranges of doc_id and tokenized; the ids of every
document are counted over the whole corpus, and the counts give one canonical
Huffman code whose words have at most ``MAX_BITS`` bits (package-merge). Then
each partition is written as independent blocks.

File format: a Parquet folder with one row a block, in ascending (part, first)
order. Columns: ``part`` (range of doc_ids), ``first`` (ids before the block
in its part), ``doc_ids`` and ``counts`` (documents of the block and their id
counts), ``checkpoints`` (bit offset of every ``STRIDE``-th id) and
``payload`` (the code words, most significant bit first). Next to it lies the
table of code lengths (``symbol``, ``bits``), from which the canonical code is
rebuilt. A block is decoded by a table of 2**MAX_BITS entries, from all of its
checkpoints at once.

Edge cases: a null or empty text holds the end id alone; repeated doc_ids keep
all rows, ordered by text; null doc_ids come first; an empty table gives an
empty result; other columns are not read; a text of any length stays whole, in
one block.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, docs_view, drop, list_column, new_path, read, release_shuffles

MAX_BITS, STRIDE, BLOCK_IDS = 20, 128, 1 << 20
IDS = "part int, doc_id long, first long, width int, ids binary, counts binary"
FILE = "part int, first long, doc_ids array<long>, counts array<int>, checkpoints array<long>, payload binary"
OUT = "part int, doc_id long, first long, n_tokens long, ids_crc32 long"
#: Text parts in one of the two generations that a worker remembers.
PARTS = 500_000
#: Documents a quarter of a written batch holds at most, and characters encoded at a time.
SLICE, SLICE_CHARS = 256, 4 << 20
#: The byte-level pattern on what a plain text holds below U+0250, where letters and digits have long been settled; and the characters that stand for bytes.
NEAR = "\u0250"
LETTER, DIGIT = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^ {LETTER}{DIGIT}]+").findall
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in SHOWN)}
_ENCODERS: dict[str, "Encoder"] = {}


def encoder_of(path: str) -> "Encoder":
    """The worker's encoder; it outlives the task, and so does what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def plain(text: str) -> bool:
    """Single spaces and line breaks between words, and no other white space; texts that aren't plain are encoded whole."""
    spaced = text.replace("\n", " ")
    return spaced.isprintable() and "  " not in spaced and spaced[:1] not in ("", " ") and spaced[-1] != " "


def parts_of(text: str) -> list[str]:
    """Words of a plain text: behind a line break they begin with it, the first with a null; the others mean a space before them."""
    return ("\0" + text).replace("\n", " \n").split(" ")


class Encoder:
    """Ids of texts as little-endian unsigned integers of 16 bits, or 32 if the ids need it, by the tokenizers library.

    The byte-level pre-tokenizer never joins what is no white space with white
    space after it, and takes a single line break alone, so texts are cut
    before single spaces and around line breaks, and the parts' ids
    remembered. Of parts not yet known, those without characters from U+0250 on
    are cut by the pre-tokenizer's pattern here, and the library's model gives
    the pieces' ids; the others go to the library together, with a line break
    after each. That holds for its pattern alone, so ``exact`` tells whether
    the file has it.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.type = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.type).itemsize
        self.end, self.line = line[0] if line else -1, np.array(line, dtype=self.type).tobytes()
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        known = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.exact = bool(known) and len(line) == 1 and not any(any(c.isspace() for c in a) for a in self.added)
        self.model, self.raw = self.tok.model, [i.to_bytes(self.width, "little") for i in range(max(self.tok.get_vocab().values(), default=-1) + 1)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.type).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[str]) -> None:
        text = {p: p[1:] if p[0] in "\0\n" else " " + p for p in parts}
        every = "\n".join(parts)
        added = [a for a in self.added if a in every]
        odd = [p for p in parts if any(a in p for a in added)] if added else []
        for p, ids in zip(odd, self.whole([text.pop(p) for p in odd])):
            self.known[p] = self.line + ids if p[0] == "\n" else ids
        known, line, raw, model = self.known, self.line, self.raw, self.model.tokenize
        parts = []
        for p, t in text.items():
            if t.isascii():
                pieces = PIECES(t)
                if t[:1] == " ":
                    pieces[0] = "Ġ" + pieces[0][1:]
            elif max(t) < NEAR:
                pieces = [x.encode().decode("latin-1").translate(BYTES) for x in PIECES(t)]
            else:
                parts.append(p)
                continue
            ids = b"".join([raw[i.id] for x in pieces for i in model(x)])
            known[p] = line + ids if p[0] == "\n" else ids
        for k in range(0, len(parts), 5_000):
            some = parts[k : k + 5_000]
            (joined,) = self.tok.encode_batch_fast(["\n".join(map(text.__getitem__, some)) + "\n"], add_special_tokens=False)
            ids, width = np.array(joined.ids, dtype=self.type), self.width
            at = np.flatnonzero(ids == self.end)
            raw, start = ids.tobytes(), 0
            if len(at) != len(some):
                raise RuntimeError("the parts' ends are not where they should be")
            for p, e in zip(some, at.tolist()):
                self.known[p] = self.line + raw[width * start : width * e] if p[0] == "\n" else raw[width * start : width * e]
                start = e + 1

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        while len(out) < len(texts):
            end, size = len(out), 0
            while end < len(texts) and (not size or size + len(texts[end]) <= SLICE_CHARS):
                size, end = size + len(texts[end]), end + 1
            some = texts[len(out) : end]
            parts = [parts_of(t) if self.exact and plain(t) else None for t in some]
            used = set().union(*(p for p in parts if p))
            if len(self.known) > PARTS:
                self.known, self.older = {}, self.known
            fresh = used.difference(self.known)
            back = self.older.keys() & fresh  # goes through fresh; set.intersection would go through all that is remembered
            self.known.update(zip(back, map(self.older.__getitem__, back)))
            self.learn(list(fresh.difference(back)))
            rest = iter(self.whole([t for t, p in zip(some, parts) if p is None]))
            out += [next(rest) if p is None else b"".join(map(self.known.__getitem__, p)) for p in parts]
        return out


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with words of at most ``limit`` bits (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.int64)
    levels, weight = [], np.empty(0, dtype=np.int64)
    for _ in range(limit):
        both = np.concatenate((leaf, weight))
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        weight = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    bits, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, dtype=np.uint8)
    out[order] = bits
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """Code words by (length, place)."""
    order = np.lexsort((np.arange(len(bits)), bits))
    words, code, last = np.zeros(len(bits), dtype=np.int64), 0, 0
    size = bits[order].astype(np.int64)
    for k, b in zip(order, size):
        code <<= b - last if last else 0
        words[k], code, last = code, code + 1, b
    return words


def pack(ids: np.ndarray, words: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' code words, and the bit offset of every STRIDE-th."""
    if not len(ids):
        return b"", np.empty(0, dtype=np.int64)
    size = bits[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    # A word of 32 bits gets all code words that begin in it, and the rest of the last one before it.
    wide = (words.astype(np.uint64) << (64 - bits.astype(np.uint64)))[ids] >> (start & 31).astype(np.uint64)
    at = start >> 5
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out = np.zeros(int(at[-1]) + 2, dtype=np.uint64)
    out[at[first]] = np.bitwise_or.reduceat(wide >> np.uint64(32), first)
    last = np.append(first[1:], len(ids)) - 1
    out[at[last] + 1] |= wide[last] & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8], start[::STRIDE]


def decode_table(symbols: np.ndarray, words: np.ndarray, bits: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For the next ``limit`` bits: the symbol they begin with, and its length."""
    sym, size = np.zeros(1 << limit, dtype=np.uint32), np.zeros(1 << limit, dtype=np.uint8)
    order = np.argsort(words << (limit - bits.astype(np.int64)))
    span = 1 << (limit - bits[order].astype(np.int64))
    sym[: span.sum()] = np.repeat(symbols[order], span)
    size[: span.sum()] = np.repeat(bits[order], span)
    return sym, size


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, sym: np.ndarray, size: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """The ids of a block: all checkpoints go forward together, one id a step."""
    data = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    win = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    out = np.zeros((STRIDE, len(checkpoints)), dtype=np.uint32)
    at, last = checkpoints.astype(np.int64), len(payload)
    for k in range(min(STRIDE, n)):
        look = (win[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & ((1 << limit) - 1)
        out[k] = sym[look]
        at = np.minimum(at + size[look], last * 8)
    return out.T.ravel()[:n]


def ids_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of every document in ascending doc_id order, as a written table; ``part`` is the range, ``first`` counts the ids before a document in it. One more row of each part holds its counts by id."""

    def run(batches):
        from pyspark import TaskContext

        part, first, encode = TaskContext.get().partitionId(), 0, encoder_of(tokenizer)
        end, width, total = np.array([end_id], dtype=encode.type).tobytes(), encode.width, np.zeros(0, dtype=np.int64)

        def rows(doc_ids, first, ids, counts):
            k = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, part, dtype=np.int32)), doc_ids, first, pa.array(np.full(k, width, dtype=np.int32)), pa.array(ids, type=pa.binary()), pa.array(counts, type=pa.binary())], names=[c.split()[0] for c in IDS.split(", ")])

        for b in batches:
            for k in range(0, b.num_rows, 4 * SLICE):
                some = b.slice(k, 4 * SLICE)
                ids = [x + end for x in encode([t or "" for t in some.column("text").to_pylist()])]
                n = np.array([len(x) // width for x in ids], dtype=np.int64)
                c = np.bincount(np.frombuffer(b"".join(ids), dtype=encode.type))
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
                yield rows(some.column("doc_id"), pa.array(first + np.cumsum(n) - n), ids, [None] * len(ids))
                first += int(n.sum())
        yield rows(pa.array([None], pa.int64()), pa.array([first]), [None], [total.astype("<i8").tobytes()])  # the partition's counts, in a row of their own

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs_view(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    out = cut(rows.mapInArrow(run, IDS), "ids", "zstd")
    release_shuffles(spark)
    return out


def global_counts(ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their counts; at most as many rows as the vocabulary reach the driver."""

    def run(batches):
        for b in batches:
            for x in b.column("counts").to_pylist():
                total = np.frombuffer(x, dtype="<i8")
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["symbol", "n"])

    rows = ids.select("counts").filter("counts is not null").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas().sort_values("symbol")
    return rows["symbol"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)


def write_ids(ids: DataFrame, path: str) -> None:
    """Write the coded file and its code table under ``path``."""
    spark = ids.sparkSession
    symbols, counts = global_counts(ids)
    bits = code_lengths(counts)
    size = int(symbols.max()) + 1 if len(symbols) else 0
    wide_words, wide_bits = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.uint8)
    wide_words[symbols], wide_bits[symbols] = canonical(bits), bits
    code = spark.sparkContext.broadcast((wide_words, wide_bits))

    def block(part, first, width, doc_ids, ids):
        words, bits = code.value
        payload, checkpoints = pack(np.frombuffer(b"".join(ids), dtype=f"<u{width}"), words, bits)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(x) // width for x in ids]], pa.list_(pa.int32())), list_column([checkpoints], pa.int64()), pa.array([payload], pa.binary())],
            names=[c.split()[0] for c in FILE.split(", ")],
        )

    def run(batches):
        part, start, doc_ids, held, size, expect = None, 0, [], [], 0, None
        for b in batches:
            for p, f, d, width, x in zip(*(b.column(c).to_pylist() for c in ("part", "first", "doc_id", "width", "ids"))):
                if held and (size >= BLOCK_IDS or (p, f) != expect):
                    yield block(part, start, width, doc_ids, held)
                    doc_ids, held, size = [], [], 0
                if not held:
                    part, start = p, f
                doc_ids.append(d)
                held.append(x)
                size += len(x) // width
                expect = (p, f + len(x) // width)
        if held:
            yield block(part, start, width, doc_ids, held)

    ids.filter("ids is not null").select("part", "first", "doc_id", "width", "ids").mapInArrow(run, FILE).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(s), int(b)) for s, b in zip(symbols, bits)], "symbol long, bits int").coalesce(1).write.parquet(f"{path}/code")


def read_code(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = spark.read.schema("symbol long, bits int").parquet(f"{path}/code").toPandas().sort_values("symbol")
    bits = rows["bits"].to_numpy(dtype=np.uint8)
    return rows["symbol"].to_numpy(dtype=np.uint32), canonical(bits), bits


def decode_blocks(spark: SparkSession, path: str, schema: str, each) -> DataFrame:
    """``each(block row, its ids)`` gives the columns of the block's rows."""
    code = spark.sparkContext.broadcast(read_code(spark, path))

    def run(batches):
        sym, size = decode_table(*code.value)
        for b in batches:
            for row in b.to_pylist():
                ids = unpack(row["payload"], np.array(row["checkpoints"], dtype=np.int64), sum(row["counts"]), sym, size)
                yield pa.RecordBatch.from_arrays(each(row, ids), names=[c.split()[0] for c in schema.split(", ")])

    return spark.read.schema(FILE).parquet(f"{path}/blocks").mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(part, first, doc_id, ids) of every document in the file."""

    def each(row, ids):
        n = np.array(row["counts"], dtype=np.int64)
        first = row["first"] + np.cumsum(n) - n
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        return [pa.array(np.full(len(n), row["part"], dtype=np.int32)), pa.array(first), pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64)))]

    return decode_blocks(spark, path, "part int, first long, doc_id long, ids array<long>", each)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the file: doc_id, start (ids of all documents before it), n_tokens and the ids' crc32."""

    def each(row, ids):
        n = np.array(row["counts"], dtype=np.int64)
        end = np.cumsum(n)
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * (b - a) : 4 * b]) for a, b in zip(n.tolist(), end.tolist())]
        return [pa.array(np.full(len(n), row["part"], dtype=np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + end - n), pa.array(n), pa.array(crc, pa.int64())]

    # One total for each part of the file: as few rows as the file has parts.
    sizes = spark.read.schema(FILE).parquet(f"{path}/blocks").select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")
    before = (sizes["n"].cumsum() - sizes["n"]).tolist()
    offsets = spark.createDataFrame([(int(p), int(b)) for p, b in zip(sizes["part"], before)], "part int, before long")
    return decode_blocks(spark, path, OUT, each).join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-file")
    ids = ids_table(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    write_ids(ids, path)
    drop(ids)
    return read_digests(spark, path)


QUERIES = {"op8_token_output": op8_token_output}
