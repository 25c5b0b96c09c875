"""SentencePiece encoding and decoding over a relational lattice (op 10).

Texts are cut into chunks that no piece crosses: a run of word marks with the
characters up to the next, and line breaks and tabs; those of
more than ``LONG`` characters are cut further, wherever two characters follow each other
in no piece. For each distinct chunk
the substrings that have a piece's hash are exploded and
equi-joined to the piece table (bounded by the model), the edges found are
grouped by chunk, and ``aggregate`` folds over them.

The models at hand are BPE models, whose scores are merge ranks. A Viterbi
search over them gives other pieces than the library does, so the fold applies
the merges: its state is the set of piece boundaries, as a bit mask, and each
step takes the edge of best score that joins two pieces (the leftmost of
equals). Single characters are where every merge begins, so their edges are
implied, and those that no merge took are filled in after the fold. Unigram models are refused.

Chunks reach documents in two ways, alike at every size: the ``HEAD`` most
frequent ones as a broadcast table, bounded by that number; all others joined
to the documents by a key of the text, so that copies of a text need them once.

Edge cases: null and empty texts have no pieces; characters outside the model
become byte pieces; chunks of more than ``LONG`` characters, whose mask
wouldn't fit, are encoded by the library itself; repeated rows and null
doc_ids each get a row; an empty table gives an empty result; other columns
are not read. Texts are taken whole.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import operator
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, docs_view, drop, list_column, read, release_shuffles

MARK = "▁"
LETTER = re.compile(r"[^\W\d_]")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters of a chunk the mask holds; chunks in the broadcast table; chunks a task counts before it passes them on.
LONG, HEAD, COUNTED = 48, 300_000, 100_000
#: Rows of a batch turned to Python objects at a time.
SLICE = 512
#: Partitions of the head's lattice, and of the other chunks' for each partition of the documents: a lattice is many times its chunks.
PARTS, SPREAD = 64, 8
#: Groups of edges that a task keeps in memory before it goes on by sorting.
GROUPS = 20_000
#: Substrings of a chunk to look up: start << 6 | length.
SPANS = "array<smallint>"


def merged(word: str, rank: dict[str, int], once: bool) -> list[int]:
    """The boundaries BPE leaves in a word: by one pass over its pieces in order of rank, or always by the best join."""
    n = len(word)
    edges = sorted((rank[word[s:e]], s, e) for s in range(n) for e in range(s + 2, n + 1) if word[s:e] in rank)
    cuts = set(range(n + 1))

    def joins(s, e):
        return s in cuts and e in cuts and sum(k in cuts for k in range(s + 1, e)) == 1

    if once:
        for _, s, e in edges:
            if joins(s, e):
                cuts.difference_update(range(s + 1, e))
        return sorted(cuts)
    while best := next(((s, e) for _, s, e in edges if joins(s, e)), None):
        cuts.difference_update(range(best[0] + 1, best[1]))
    return sorted(cuts)


@functools.lru_cache(maxsize=4)
def load(path: str) -> "Pieces":
    return Pieces(path)


@functools.lru_cache(maxsize=2)
def restored(state: bytes) -> "Pieces":
    """The pieces from their state; a worker keeps them over tasks."""
    out = Pieces.__new__(Pieces)
    out.__dict__.update(pickle.loads(state))
    return out


class Pieces:
    """The model's pieces, ids and scores, read by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in every if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        special = {i for i in every if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        self.normal = [(sp.id_to_piece(i), i, int(-sp.get_score(i))) for i in every if i not in special]
        self.table = [b"" if i in special else sp.id_to_piece(i).encode() for i in every]
        for value, i in self.bytes.items():
            self.table[i] = bytes([value])
        self.names = frozenset(p for p, _, _ in self.normal)
        self.single = {p: i for p, i, _ in self.normal if len(p) == 1}
        # Hashes of what pieces begin with, in order, and whether each is a piece.
        begins = list({p[:k] for p in self.names for k in range(2, len(p) + 1)})
        code, size = code_points(begins)
        hashes, at = np.zeros(len(begins), dtype=np.uint64), np.cumsum(size) - size
        for k in range(max(size, default=0)):
            some = np.flatnonzero(size > k)
            hashes[some] = longer(hashes[some], code[at[some] + k])
        order = np.argsort(hashes)
        self.begins, self.whole = hashes[order], np.array([p in self.names for p in begins])[order]
        self.type = "<u2" if len(self.table) <= 1 << 16 else "<i4"
        self.check(sp)
        self.pairs = frozenset(p[k : k + 2] for p in self.names for k in range(len(p) - 1))
        # Signs that stand behind a letter in no piece: chunks end before them.
        behind = {x[1] for x in self.pairs if x[0].isalpha()}
        free = re.escape("".join(c for c in SIGNS if c not in behind))
        letter = "".join(sorted({x[0] for x in self.pairs if LETTER.match(x[0]) and not x[0].isalpha()})).join(("[^\\W\\d_", "]"))
        rest = f"[^{MARK}\n\t{free}]*"
        self.chunk = re.compile(f"[\n\t]|{MARK}*[^{MARK}\n\t]{rest}" + (f"(?:(?<!{letter})[{free}]{rest})*" if free else "") + f"|{MARK}+")
        rank = {p: r for p, _, r in self.normal}
        self.late = {p for p, _, _ in self.normal if len(p) > 2 and merged(p, rank, True) != merged(p, rank, False)}

    def __reduce__(self):
        return restored, (pickle.dumps(self.__dict__, protocol=5),)

    def check(self, sp) -> None:
        """Refuse what the chunks and the fold don't hold for."""
        whole = all(-sp.get_score(i) == int(-sp.get_score(i)) for _, i, _ in self.normal)
        inner = re.compile(f"[^{MARK}]{MARK}|[\n\t].|.[\n\t]")
        plain = all(sp.decode(sp.encode(t)) == t for t in (" a  b ", "Ａ́ x")) and sp.encode("a", out_type=str)[0].startswith(MARK)
        if not whole or not plain or any(inner.search(p) for p, _, _ in self.normal):
            raise ValueError("only BPE models with identity normalisation are supported")

    def chunks(self, text: str | None) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def units(self, chunk: str) -> list[str]:
        """The chunk itself if the mask holds it, else its parts."""
        return [chunk] if len(chunk) <= LONG else self.parts(chunk)

    def parts(self, chunk: str) -> list[str]:
        """The chunk, cut between characters that follow each other in no piece."""
        pairs, after = self.pairs, chunk[1:]
        if pairs.issuperset(map(operator.add, chunk, after)):
            return [chunk]
        out, at = [], 0
        for k, pair in enumerate(map(operator.add, chunk, after), 1):
            if pair not in pairs:
                out.append(chunk[at:k])
                at = k
        return [*out, chunk[at:]]

    def spans(self, chunk: str) -> list[int]:
        """The substrings of a chunk to look up, as start << 6 | length."""
        return self.all_spans([chunk])[1].tolist()

    def all_spans(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk's spans begin, and the spans of all: the substrings of several characters that have the hash of a piece.

        Single characters are implied. A chunk without others keeps its first one, so that its row stays.
        """
        code, size = code_points(chunks)
        last = np.cumsum(size)
        begin, end = last - size, np.repeat(last, size)
        at, hashes, found = np.arange(len(code)), longer(np.zeros(len(code), dtype=np.uint64), code), []
        # Longer by one character at a time, as long as pieces begin so.
        for k in range(2, LONG + 1):
            some = np.flatnonzero(at + k <= end[at])
            at = at[some]
            hashes = longer(hashes[some], code[at + (k - 1)])
            place = np.minimum(np.searchsorted(self.begins, hashes), len(self.begins) - 1)
            some = np.flatnonzero(self.begins[place] == hashes)
            if not len(some):
                break
            at, hashes = at[some], hashes[some]
            pieces = at[self.whole[place[some]]]
            found.append(np.stack([pieces, np.full(len(pieces), k)]))
        at, k = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        of = np.repeat(np.arange(len(chunks)), size)
        bare = np.flatnonzero(np.bincount(of[at], minlength=len(chunks)) == 0)
        of = np.concatenate([of[at], bare])
        spans = np.concatenate([at - begin[of[: len(at)]] << 6 | k, np.ones(len(bare), dtype=np.int64)])
        order = np.argsort(of, kind="stable")
        return np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(chunks))))), spans[order].astype(np.int16)

    def character(self, char: str) -> list[int]:
        """Its piece, or those of its bytes if it is outside the model."""
        return [self.single[char]] if char in self.single else [self.bytes.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    @functools.cached_property
    def singles(self) -> np.ndarray:
        """Piece by code point; -1 where there is none."""
        out = np.full(0x110000, -1, dtype=np.int32)
        for char, i in self.single.items():
            out[ord(char)] = i
        return out

    @functools.cached_property
    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces, one after the other, with where each begins and its length."""
        size = np.array([len(p) for p in self.table])
        return np.frombuffer(b"".join(self.table), dtype=np.uint8), np.cumsum(size) - size, size


def longer(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hashes of strings with one more character."""
    x = (hashes ^ codes) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values that begin at ``begin``, one after the other."""
    after = np.cumsum(size)
    return values[np.repeat(begin - after + size, size) + np.arange(after[-1] if len(after) else 0)]


def lattice(words: DataFrame, keys: list[str], pieces: Pieces) -> DataFrame:
    """Add ``used`` to the rows (keys, chunk, spans), which must be distinct: the pieces of several characters, as start << 25 | end << 19 | id.

    The edges are grouped by the columns the rows are dealt by, so no exchange follows.
    """
    spark = words.sparkSession
    # As many rows as the model has pieces.
    codes = [(p, (r << 32) | (p in pieces.late) << 19 | i) for p, i, r in pieces.normal]
    table = spark.createDataFrame(codes, "known string, code long").withColumn("hash", F.xxhash64("known"))
    spans = words.select(*keys, "chunk", F.explode("spans").alias("span"))
    spans = spans.withColumn("piece", F.expr("substring(chunk, shiftright(span, 6) + 1, span & 63)")).withColumn("mark", F.xxhash64("piece"))
    # Hashes make the join's key a number; the pieces themselves are compared as well.
    edges = spans.join(F.broadcast(table), (F.col("mark") == F.col("hash")) & (F.col("piece") == F.col("known")), "left")
    # An edge is one number: rank, start, end, whether it may come late, id. Sorting by it sorts by rank.
    edges = edges.select(*keys, "chunk", F.expr("if(span = 1, null, code) | shiftleft(cast(shiftright(span, 6) as bigint), 26) | shiftleft(cast(shiftright(span, 6) + (span & 63) as bigint), 20)").alias("edge"))
    return fold(edges.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("edge")).alias("edges")), keys)


def fold(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Apply the merges to each chunk's edges, best first.

    One pass over the edges in order of rank does what choosing the best edge
    again and again does, unless an edge is joined after its turn. While both
    its ends are boundaries, what happens between them is what happens in the
    piece alone; so only pieces that alone are joined late matter, and chunks
    with such an edge are folded the long way.
    """
    start, end = "cast(shiftright(x, 26) & 63L as int)", "cast(shiftright(x, 20) & 63L as int)"
    ends, inner = f"(shiftleft(1L, {start}) | shiftleft(1L, {end}))", f"(shiftleft(1L, {end}) - shiftleft(1L, {start} + 1))"
    full = "shiftleft(1L, length(chunk) + 1) - 1"
    joins = f"(mask & {ends}) = {ends} and bit_count(mask & {inner}) = 1"
    once = f"aggregate(edges, {full}, (mask, x) -> if({joins}, mask & ~{inner}, mask))"
    again = f"""aggregate(sequence(1, greatest(length(chunk) - 1, 1)), {full},
        (mask, i) -> coalesce(get(transform(slice(filter(edges, x -> {joins}), 1, 1), x -> mask & ~{inner}), 0), mask))"""
    mask = f"if(exists(edges, x -> (shiftright(x, 19) & 1L) = 1L), {again}, {once})"
    left = f"filter(edges, x -> (mask & {ends}) = {ends} and (mask & {inner}) = 0L)"
    used = f"sort_array(transform({left}, x -> shiftleft({start}, 25) | shiftleft({end}, 19) | cast(x & 524287L as int)))"
    # The transform computes the mask once; a column would be computed wherever it is used.
    return grouped.select(*keys, "chunk", F.expr(f"get(transform(array({mask}), mask -> {used}), 0)").alias("used"))


def sliced(batches):
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            yield b.slice(k, SLICE)


def count_chunks(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(chunk, n) for the chunks of all texts, long ones cut to parts, that the mask holds."""

    def run(batches):
        seen: Counter = Counter()

        def rows():
            parts: Counter = Counter()
            for c, n in seen.items():
                for p in pieces.units(c):
                    parts[p] += n
            keep = [p for p in parts if len(p) <= LONG]
            return pa.RecordBatch.from_arrays([pa.array(keep, pa.string()), pa.array([parts[p] for p in keep], pa.int64())], names=["chunk", "n"])

        for b in sliced(batches):
            for t in b.column("text").to_pylist():
                seen.update(pieces.chunks(t))
                if len(seen) > COUNTED:
                    yield rows()
                    seen.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def with_spans(chunks: list[str], pieces: Pieces) -> pa.RecordBatch:
    at, spans = pieces.all_spans(chunks)
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.string()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(spans))], names=["chunk", "spans"])


def head_table(docs: DataFrame, pieces: Pieces, head: int = HEAD) -> bytes:
    """A packed table with the ids of the most frequent chunks: all at or above the least frequency that keeps them within ``head``."""
    counts = cut(count_chunks(docs, pieces), "chunk-counts")
    release_shuffles(docs.sparkSession)
    level = F.floor(F.log2("n") * 32)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        total += n
        if total > head:
            break
        least = at
    if least is None:
        return packed({})

    def spans(batches):
        for b in batches:
            yield with_spans(b.column("chunk").to_pylist(), pieces)

    # Dealt by chunk before the lattice multiplies the rows.
    chunks = counts.filter(level >= least).select("chunk").mapInArrow(spans, f"chunk string, spans {SPANS}")
    found = lattice(chunks.repartition(PARTS, "chunk"), [], pieces).toArrow()
    drop(counts)
    release_shuffles(docs.sparkSession)
    table: dict[str, bytes] = {}
    for b in found.to_batches():
        chunks = b.column("chunk").to_pylist()
        table.update(zip(chunks, to_bytes(chunks, b.column("used"), pieces)))
    return packed(table)


def to_bytes(chunks: list[str], used: pa.ListArray, pieces: Pieces) -> list[bytes]:
    """Little-endian ids of the model's type, by chunk: the pieces the fold left, and between them single characters."""
    code, size = code_points(chunks)
    last = np.cumsum(size)
    begin = last - size
    x = used.flatten().to_numpy(zero_copy_only=False)
    of = np.repeat(begin, pc.list_value_length(used).to_numpy(zero_copy_only=False))
    start, end = of + (x >> 25), of + (x >> 19 & 63)
    ids = pieces.singles[code]
    ids[start] = x & 0x7FFFF
    inside = np.zeros(len(code) + 1, dtype=np.int32)
    inside[start + 1] += 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    n = np.where(inside, 0, 1)
    bare = np.flatnonzero((ids < 0) & ~inside)
    own = [pieces.character(chr(c)) for c in code[bare].tolist()]
    n[bare] = [len(o) for o in own]
    after = np.concatenate(([0], np.cumsum(n)))
    out = np.repeat(ids, n)
    for k, o in zip(after[bare].tolist(), own):
        out[k : k + len(o)] = o
    raw, width = out.astype(pieces.type).tobytes(), np.dtype(pieces.type).itemsize
    return [raw[a:b] for a, b in zip((width * after[begin]).tolist(), (width * after[last]).tolist())]


def rest_by_row(rest: pa.ListArray, pieces: Pieces) -> list[dict[str, bytes]]:
    """Chunk to ids for each row; null rows have none."""
    flat = rest.flatten()
    # Of a struct's fields, those of the rows at hand.
    chunks, used = flat.flatten()
    chunks = chunks.to_pylist()
    every = zip(chunks, to_bytes(chunks, used, pieces))
    return [dict(itertools.islice(every, n or 0)) for n in pc.list_value_length(rest).to_pylist()]


def packed(table: dict) -> bytes:
    return zlib.compress(pickle.dumps(table, protocol=5), 1)


def give_back() -> None:
    """Return to the system what earlier tasks of this worker have freed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Head(dict):
    """The head table; ``missing`` gives the ids of other chunks."""

    def __missing__(self, chunk: str) -> bytes:
        return self.missing(chunk)


_LAST: dict[bytes, Head] = {}


def unpacked(data: bytes) -> Head:
    """The table; a worker keeps its last one over tasks."""
    name = data[-64:]
    if name not in _LAST:
        give_back()
        _LAST.clear()
        _LAST[name] = Head(pickle.loads(zlib.decompress(data)))
    return _LAST[name]


class Found:
    """Ids of chunks: from the head table, from the parts a row brings along in ``own``, or for long parts from the library."""

    def __init__(self, head: "Head", pieces: Pieces, model: str):
        self.head, self.pieces, self.model, self.own = head, pieces, model, {}
        head.missing, self.of = self.cut, head.__getitem__

    def cut(self, chunk: str) -> bytes:
        if len(chunk) <= LONG:
            return self.own[chunk]
        return b"".join([self.head[p] if p in self.head else self.part(p) for p in self.pieces.parts(chunk)])

    def part(self, part: str) -> bytes:
        if part not in self.own:
            self.own[part] = long_chunk(library(self.model), part, self.pieces.type)
        return self.own[part]


@functools.lru_cache(maxsize=2)
def library(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@functools.lru_cache(maxsize=1)
def codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def squeezed(batches):
    """(doc_id, key, n, text) with the texts compressed, n bytes long before."""
    for b in sliced(batches):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array([len(t) for t in texts], pa.int32()), pa.array([codec().compress(t, asbytes=True) for t in texts], pa.binary())], names=["doc_id", "key", "n", "text"])


def encode(docs: DataFrame, model: str, out: str, each, head: int = HEAD) -> DataFrame:
    """Rows of schema ``out``, made by ``each(doc_ids, ids, same)`` from the documents' ids and whether they decode to the text."""
    spark, pieces = docs.sparkSession, load(model)
    bound_batches(spark)
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS))
    docs = docs_view(docs).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    table = spark.sparkContext.broadcast(head_table(docs, pieces, head))

    def rare(batches):
        have, sent = unpacked(table.value), set()
        for b in sliced(batches):
            rows = []
            if len(sent) > COUNTED:
                sent.clear()
            for key, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                if key in sent:
                    continue
                sent.add(key)
                parts = {p for c in set(pieces.chunks(t)) if c not in have for p in pieces.units(c)}
                if r := [p for p in parts if p not in have and len(p) <= LONG]:
                    rows.append((key, r))
            at = pa.array(np.cumsum([0] + [len(r) for _, r in rows]), pa.int32())
            found = with_spans([c for _, r in rows for c in r], pieces)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(found.columns, names=found.schema.names))], names=["key", "chunks"])

    # A task passes a key on once, so copies are few before the exchange. Dealt by the text's key once; the lattice of its chunks stays where they are.
    rest = docs.mapInArrow(rare, f"key long, chunks array<struct<chunk: string, spans: {SPANS}>>").repartition(SPREAD * max(1, docs.rdd.getNumPartitions()), "key").groupBy("key").agg(F.first("chunks").alias("chunks")).select("key", F.inline("chunks"))
    rest = lattice(rest, ["key"], pieces).groupBy("key").agg(F.collect_list(F.struct("chunk", "used")).alias("rest"))
    joined = docs.mapInArrow(squeezed, "doc_id long, key long, n int, text binary").join(rest, "key", "left")

    def run(batches):
        have = Found(unpacked(table.value), pieces, model)
        for b in sliced(batches):
            ids = []
            texts = [codec().decompress(t, n).to_pybytes() for t, n in zip(b.column("text").to_pylist(), b.column("n").to_pylist())]
            for t, have.own in zip(texts, rest_by_row(b.column("rest"), pieces)):
                ids.append(np.frombuffer(b"".join(map(have.of, pieces.chunks(t.decode("utf-8", "surrogatepass")))), dtype=pieces.type))
            yield each(b.column("doc_id"), ids, [decoded(x, pieces) == t.replace(MARK.encode(), b" ") for x, t in zip(ids, texts)])

    return joined.select("doc_id", "n", "text", "rest").mapInArrow(run, out)


def long_chunk(sp, chunk: str, kind: str) -> bytes:
    """The library's ids of one chunk; it puts a mark before a text, so one is taken off or the mark's piece dropped."""
    if chunk.startswith(MARK):
        return np.array(sp.encode(chunk[1:]), dtype=kind).tobytes()
    return np.array(sp.encode("\n" + chunk)[len(sp.encode("\n")) :], dtype=kind).tobytes()


def decode(ids: list[int], table: list[bytes]) -> bytes:
    """The text's bytes."""
    text = b"".join(map(table.__getitem__, ids)).replace(MARK.encode(), b" ")
    return text[1:] if text.startswith(b" ") else text


def decoded(ids: np.ndarray, pieces: Pieces) -> bytes:
    """As ``decode``."""
    raw, begin, size = pieces.texts
    text = gathered(raw, begin[ids], size[ids]).tobytes().replace(MARK.encode(), b" ")
    return text[1:] if text.startswith(b" ") else text


def encode_documents(docs: DataFrame, model: str, head: int = HEAD) -> DataFrame:
    """(doc_id, ids) of every row."""

    def each(doc_ids, ids, same):
        return pa.RecordBatch.from_arrays([doc_ids, list_column(ids, pa.int32())], names=["doc_id", "ids"])

    return encode(docs, model, "doc_id long, ids array<int>", each, head)


def decode_documents(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    table = load(model).table

    def run(batches):
        for b in batches:
            texts = [decode(x or [], table).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def same_text(ids: list[int], text: str | None, table: list[bytes]) -> bool:
    """Whether decoding gives the text back."""
    return decode(ids, table) == (text or "").encode("utf-8", "surrogatepass").replace(MARK.encode(), b" ")


def encode_and_decode(docs: DataFrame, model: str, head: int = HEAD) -> DataFrame:
    """(doc_id, ids, round_trip) of every row: whether decoding the ids gives the text back."""

    def each(doc_ids, ids, same):
        return pa.RecordBatch.from_arrays([doc_ids, list_column(ids, pa.int32()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "round_trip"])

    return encode(docs, model, "doc_id long, ids array<int>, round_trip boolean", each, head)


def piece_digests(docs: DataFrame, model: str, head: int = HEAD) -> DataFrame:
    """Per row: the number of pieces, the crc32 of the ids as little-endian unsigned 32-bit integers, and whether decoding gives the text back."""

    def each(doc_ids, ids, same):
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return encode(docs, model, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean", each, head)


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op10_piece_lattice": op10_piece_lattice}
