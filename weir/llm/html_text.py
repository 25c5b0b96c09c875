"""Main text of web pages, with a suffix array for each host (op 6).

A page is cut into blocks by its markup. Structure decides what it can: menus,
headers, footers, sidebars, forms, scripts, notices, adverts and comments (by
tag, role, class or id) go; blocks inside an article or main element stay.
The blocks left are undecided: pages without such an element consist of them.

The pages of a host are taken together, whatever its size. A run of ``RUN``
tokens is repeated if it stands on distinct pages; ``repeated_tokens`` finds
such runs of pages at hand in a suffix array sorted to that depth. Over a
whole host the same groups of equal runs are counted by 64-bit hash: pages are
packed into chunks. Each first sends the upper bits of the sorted hashes of its
distinct runs, by range of hashes, and gets back which of them other chunks
have too. Those runs alone it then sends with their whole hash, and gets back
on how many pages each stands; the others stand on pages of this chunk only.
Neither the chunks nor the number of upper bits change a result, and a run that
all pages share is one entry a chunk. The chunks lie in buckets, so their texts
go through no exchange.

Pages of equal tokens count as one there, so a mirror makes nothing repeated.
An undecided block loses the tokens of runs that stand on many pages of the
host (``needed``), where they begin or end the block; repeated runs within it
stay, as a quotation does. Article blocks keep repeated runs too, since an
article may stand under two addresses; ``n_repeated`` tells how many of their
tokens lie in runs that another page holds.

Edge cases: a null or empty page, and one with nothing but boilerplate, gives
an empty text; broken markup is read as browsers do (unclosed elements end
with what holds them); a null url is a host of its own; repeated rows each get
a row; an empty table gives an empty result; other columns are not read. Pages
of any length are read whole.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, cut, cut_buckets, drop, list_column, mix, read, release_shuffles, to_signed

#: Tokens of a repeated run, and distinct pages of a host (at most) that make it boilerplate.
RUN, BOILER_PAGES = 8, 10
#: Characters of a chunk, and runs of a range of hashes; neither changes results.
CHUNK_CHARS, RANGE_RUNS = 8 << 20, 1 << 20
#: Upper bits sent first, beyond those that number all runs: about one run in 16 is then sent whole for nothing.
SPARE_BITS = 4
#: Of compression: a fifth less than level 1 gives.
LEVEL = 5
PACKED = "chunk long, ids array<long>, urls array<string>, hosts array<long>, keys array<long>, pages binary, n_tokens long"
OUT = "page_id long, url string, text string, n_chars long, n_repeated long"
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>|<[!?][^<>]*>", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
#: Elements whose content is no text, up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no part of an article.
BOILER_TAGS = frozenset("head nav footer aside form button select menu dialog fieldset datalist".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments disqus respond reply replies breadcrumb breadcrumbs pagination pager related recommended widget toolbar search copyright legal disclaimer masthead".split()
)
#: Inside an article these name what the article says, as small print or a list of results.
MILD_WORDS = frozenset("legal copyright disclaimer search alert login signup masthead overlay".split())
#: Parts of a class name that say nothing of their own; with any other part the name isn't boilerplate.
NEUTRAL = frozenset(
    "main site page post posts entry top bottom left right primary secondary global header box bar bars area block blocks button buttons icon icons container wrap wrapper inner outer list item items link links slot unit section content module panel text form user reader "
    "message policy js u l c m s the row column col group strip footer1 footer2 slider carousel zone label".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_WORDS = frozenset("articlebody postcontent entrycontent".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of the first kind ends when one of the second begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROP, MAIN, OTHER = 0, 1, 2


def name_words(name: str) -> set:
    """What a class or id says: its boilerplate words if all its parts are such or neutral, else itself."""
    parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)]
    words = {p for p in parts if p in BOILER_WORDS}
    if words and all(p in BOILER_WORDS or p in NEUTRAL or p.isdigit() or len(p) == 1 for p in parts):
        return words
    return {"".join(parts)} | ({"header"} if "header" in parts else set())


def attributes(text: str) -> tuple[set, str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    words, role, gone = set(), "", False
    for m in ATTR.finditer(text):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for w in value.split():
                words |= name_words(w)
        elif name == "role":
            role = value.lower()
        elif m[5] or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            gone = True
    return words, role, gone


def verdict(tag: str, rest: str, inside: int, in_main: bool) -> int:
    """What an element's content is, by its own markup; ``inside`` is what holds it."""
    if tag in ("html", "body"):
        return inside
    words, role, gone = attributes(rest) if rest else ((), "", False)
    if gone or tag in BOILER_TAGS or role in BOILER_ROLES:
        return DROP
    if tag in ("article", "main") or role in ("main", "article"):
        return DROP if "comment" in words or "comments" in words or "related" in words or inside == DROP and in_main else MAIN
    if inside == DROP:
        return DROP
    if words and not (words - MILD_WORDS if in_main else words).isdisjoint(BOILER_WORDS) or tag == "header" or "header" in words and tag in ("div", "section"):
        return DROP
    return MAIN if words and not MAIN_WORDS.isdisjoint(words) else inside


def blocks(page: str) -> list[tuple[int, str]]:
    """(verdict, text) of the page's blocks in order; empty ones are left out."""
    out, buffer, at = [], [], 0
    # Open elements: tag, verdict of the content, and whether an article or main element holds it.
    stack: list[tuple[str, int, bool]] = [("", OTHER, False)]

    def flush():
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((stack[-1][1], text))

    def close(k):
        flush()
        del stack[k:]

    def find(names, until=()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in until:
                return 0
        return 0

    while m := TAG.search(page, at):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                k = find({tag}, until={"p", "li", "td", "div", "article"})
                if k and k == len(stack) - 1:
                    if stack[k][1] != stack[k - 1][1]:
                        flush()
                    del stack[k:]
                continue
            k = find({tag})
            if k:
                close(k)
            else:
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^<>]*>", re.I).search(page, at)
            if tag != "svg" or not m[3].rstrip().endswith("/"):
                at = end.end() if end else len(page) if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag == "br" or tag in VOID:
            if tag in ("br", "img", "wbr", "input"):
                buffer.append(" " if tag == "br" else "")
            else:
                flush()
            continue
        if tag in INLINE:
            v = verdict(tag, m[3], stack[-1][1], stack[-1][2])
            if v != stack[-1][1]:
                flush()
            stack.append((tag, v, stack[-1][2]))
            continue
        k = find({"p"}, until={"table", "td", "button", "article"})
        close(k) if k else flush()
        if tag == "body" and (k := find({"head"})):
            close(k)
        if tag in ENDS and (k := find(ENDS[tag], until={"ul", "ol", "dl", "table", "select"} if tag != "td" else {"tr", "table"})):
            close(k)
        inside, in_main = stack[-1][1], stack[-1][2]
        v = verdict(tag, m[3], inside, in_main)
        if tag in HEADINGS and in_main and inside == DROP and stack[-1][0] == "header":
            v = MAIN  # the title of an article that stands in its header
        stack.append((tag, v, in_main or v == MAIN))
    buffer.append(page[at:])
    flush()
    return out


def repeated_tokens(pages: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """For each page's tokens, whether a run of ``run`` tokens around them also stands on another page."""
    length = np.array([len(p) for p in pages], dtype=np.int64)
    names: dict[str, int] = {}
    n_pages = len(pages)
    # The stream ends each page by a token of its own, so no run crosses pages.
    stream = np.fromiter((x for k, p in enumerate(pages) for x in (*(names.setdefault(w, len(names) + n_pages) for w in p), k)), dtype=np.int64, count=int(length.sum()) + n_pages)
    n = len(stream)
    page = np.repeat(np.arange(n_pages), length + 1)
    rank, depth = stream, 1
    while depth < run:  # ranks of suffixes by their first 2 * depth tokens
        step = min(depth, run - depth)
        after = np.full(n, -1, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    order = np.lexsort((page, rank))  # the suffix array to that depth
    r, p = rank[order], page[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    last = np.append(first[1:], n) - 1
    shared = (p[first] != p[last])[group]
    edge = np.zeros(n + run + 1, dtype=np.int64)
    starts = order[shared]
    edge[: n + run + 1] += np.bincount(starts, minlength=n + run + 1) - np.bincount(starts + run, minlength=n + run + 1)
    covered = np.cumsum(edge)[:n] > 0
    end = np.cumsum(length + 1)
    return [covered[e - k - 1 : e - 1] for e, k in zip(end, length)]


def needed(pages: int) -> int:
    """Pages a run must stand on to be boilerplate, of a host with so many distinct ones: half of them, at least 2, at most ``BOILER_PAGES``."""
    return max(2, min(BOILER_PAGES, (pages + 1) // 2))


def unique_part(tokens: list[str], covered: np.ndarray) -> str:
    """The tokens without the covered runs that begin or end the block."""
    own = np.flatnonzero(~covered)
    return " ".join(tokens[own[0] : own[-1] + 1]) if len(own) else ""


def squeeze(pages: list[str]) -> bytes:
    """The packed pages of a chunk, compressed, with their length in front; texts hold no form feeds."""
    raw = "\f".join(pages).encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def unsqueeze(raw: bytes) -> list[str]:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\f")


def split_page(page: str) -> list[tuple[int, str]]:
    """The blocks of a packed page: a line for each, the verdict in front."""
    return [(int(line[0]), line[1:]) for line in page.split("\n")] if page else []


def run_hashes(pages: list[list[str]], hosts: list[int], words: WordHashes, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's runs: hashes, places in the stream of all tokens, and pages; and where each page ends."""
    length = np.array([len(p) for p in pages], dtype=np.int64)
    end = np.cumsum(length)
    stream = words.of([t.encode("utf-8", "surrogatepass") for p in pages for t in p])
    page = np.repeat(np.arange(len(pages)), length)
    starts = np.flatnonzero(np.arange(len(stream)) + run <= end[page]) if len(stream) else np.zeros(0, dtype=np.int64)
    page = page[starts]
    h, mixed = np.zeros(len(starts), dtype=np.uint64), mix(stream)
    for k in range(run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[starts + k]
    return mix(h ^ np.array(hosts, dtype=np.int64).view(np.uint64)[page]), starts, page, end


class Runs:
    """The runs of a chunk's pages. starts: places in the stream of all tokens; page: of each start; names: sorted distinct hashes; at: the name of each start."""

    def __init__(self, pages: list[list[str]], hosts: list[int], words: WordHashes, run: int):
        h, self.starts, self.page, self.end = run_hashes(pages, hosts, words, run)
        self.n, self.run = int(self.end[-1]) if len(self.end) else 0, run
        self.order = np.lexsort((self.page, h))
        s = h[self.order]
        self.fresh = np.append(True, s[1:] != s[:-1])[: len(s)]
        self.names = s[self.fresh]
        self.at = np.empty(len(s), dtype=np.int64)
        self.at[self.order] = np.cumsum(self.fresh) - 1

    def counts(self, copies: set[int]) -> np.ndarray:
        """For each name, its pages in this chunk without ``copies``."""
        p = self.page[self.order]
        new = self.fresh | np.append(True, p[1:] != p[:-1])[: len(p)]
        if copies:
            new &= ~np.isin(p, list(copies))
        return np.bincount(np.cumsum(self.fresh) - 1, weights=new, minlength=len(self.names)).astype(np.int64)

    def met(self, seen: list[tuple[int, int, bytes]], width: int) -> np.ndarray:
        """For each name, whether another chunk has its upper bits, by what ``meet`` gave back as (range, number, bits)."""
        upper = self.names >> np.uint64(64 - width)
        which = np.cumsum(np.append(False, upper[1:] != upper[:-1])[: len(upper)])
        return np.concatenate([np.zeros(0, dtype=bool), *(from_bits(x, n) for _, n, x in sorted(seen))])[which]

    def covered(self, hit: np.ndarray) -> list[np.ndarray]:
        """For each page's tokens, whether they lie in a run that is ``hit`` (by start)."""
        starts = self.starts[hit]
        edge = np.bincount(starts, minlength=self.n + 1) - np.bincount(starts + self.run, minlength=self.n + 1)
        return np.split(np.cumsum(edge)[: self.n] > 0, self.end[:-1])


def range_bounds(names: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    """Where each of the 2 ** bits ranges begins in sorted hashes of so many bits, and the end."""
    return np.append(np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)), len(names))


def planes(names: np.ndarray) -> bytes:
    """Sorted hashes as gaps, byte by byte and compressed: the upper bytes are nearly all zero."""
    return pa.compress(np.diff(names, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def from_planes(raw: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def to_bits(mask: np.ndarray) -> bytes:
    return pa.compress(np.packbits(mask).tobytes(), codec="zstd", asbytes=True)


def from_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(pa.decompress(raw, (n + 7) // 8, codec="zstd", asbytes=True), dtype=np.uint8), count=n).view(bool)


def meet(group: pa.Table) -> pa.Table:
    """For each chunk's upper bits of one range of hashes, whether another chunk has them."""
    n = group.column("n").to_pylist()
    _, at, times = np.unique(np.concatenate([from_planes(x, k) for x, k in zip(group.column("upper").to_pylist(), n)]), return_inverse=True, return_counts=True)
    parts = np.split((times > 1)[at], np.cumsum(n)[:-1])
    return pa.table({"chunk": group.column("chunk"), "range": group.column("range"), "n": group.column("n"), "bits": pa.array([to_bits(p) for p in parts], pa.binary())})


def add_up(group: pa.Table) -> pa.Table:
    """Counts over all chunks for each chunk's runs of one range of hashes."""
    counts = group.column("counts").to_pylist()
    names = [from_planes(x, len(c)) for x, c in zip(group.column("names").to_pylist(), counts)]
    counts = np.frombuffer(b"".join(counts), dtype=np.uint8)
    _, at = np.unique(np.concatenate(names), return_inverse=True)
    total = np.minimum(np.bincount(at, weights=counts), 255).astype(np.uint8)[at]
    parts = np.split(total, np.cumsum([len(n) for n in names])[:-1])
    return pa.table({"chunk": group.column("chunk"), "range": group.column("range"), "totals": pa.array([p.tobytes() for p in parts], pa.binary())})


def pack(pages: DataFrame, chunk_chars: int) -> DataFrame:
    """A row for each chunk of pages: their ids, urls, hosts and streams (as hashes) and blocks."""

    def run(batches):
        from pyspark import TaskContext

        held, size, n = [], 0, 0

        def done():
            part = TaskContext.get().partitionId()
            cut = [[f"{v}{t}" for v, t in blocks(h)] if h else [] for _, _, _, h in held]
            hosts = [xxhash.xxh3_64_intdigest(host.encode()) for _, _, host, _ in held]
            streams = [" ".join(x[1:] for x in c) for c in cut]
            keys = [xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"), seed=h) for s, h in zip(streams, hosts)]
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 33) + n], pa.int64()), one([i for i, _, _, _ in held], pa.int64()), one([u for _, u, _, _ in held], pa.string()), list_column([to_signed(hosts)], pa.int64()), list_column([to_signed(keys)], pa.int64()),
                 pa.array([squeeze(["\n".join(c) for c in cut])], pa.binary()), pa.array([sum(s.count(" ") + 1 for s in streams)], pa.int64())],
                names=[c.split()[0] for c in PACKED.split(", ")],
            )

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "html"))):
                held.append(row)
                size += len(row[3] or "")
                if size >= chunk_chars:
                    yield done()
                    held, size, n = [], 0, n + 1
        if held:
            yield done()

    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    buckets = min(100_000, max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * pages.rdd.getNumPartitions()))
    return cut_buckets(rows.mapInArrow(run, PACKED), "html-chunks", "chunk", buckets)


def main_text(pages: DataFrame, run: int = RUN, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per page: url, main text and its length in code points."""
    spark = pages.sparkSession
    chunks = pack(pages, chunk_chars)
    n_tokens = int(chunks.agg(F.sum("n_tokens")).first()[0] or 0)
    bits = max(4, (n_tokens // RANGE_RUNS).bit_length())
    width = min(64, n_tokens.bit_length() + SPARE_BITS)

    def tokens_of(page):
        return [b.split() for _, b in split_page(page)]

    def announce(batches):
        words = WordHashes()
        for b in batches:
            for chunk, hosts, texts in zip(*(b.column(c).to_pylist() for c in ("chunk", "hosts", "pages"))):
                words.trim()
                h = run_hashes([[t for part in tokens_of(p) for t in part] for p in unsqueeze(texts)], hosts, words, run)[0]
                h >>= np.uint64(64 - width)
                h.sort()
                upper = h[np.append(True, h[1:] != h[:-1])[: len(h)]]
                bound = range_bounds(upper, bits, width)
                full = np.flatnonzero(np.diff(bound))
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array(np.diff(bound)[full], pa.int32()), pa.array([planes(upper[bound[k] : bound[k + 1]]) for k in full], pa.binary())], names=["chunk", "range", "n", "upper"])

    def own(runs, same, seen):
        """For each name, its pages in this chunk, and whether other chunks may hold it."""
        counts = np.minimum(runs.counts({x["pos"] for x in same or () if x["extra"]}), 255).astype(np.uint8)
        return counts, runs.met([(x["range"], x["n"], x["bits"]) for x in seen or ()], width)

    def send(batches):
        words = WordHashes()
        for b in batches:
            for chunk, hosts, texts, same, seen in zip(*(b.column(c).to_pylist() for c in ("chunk", "hosts", "pages", "same", "seen"))):
                words.trim()
                runs = Runs([[t for part in tokens_of(p) for t in part] for p in unsqueeze(texts)], hosts, words, run)
                counts, met = own(runs, same, seen)
                names, counts = runs.names[met], counts[met]
                bound = range_bounds(names, bits)
                full = np.flatnonzero(np.diff(bound))
                cells = [(names[bound[k] : bound[k + 1]], counts[bound[k] : bound[k + 1]]) for k in full]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([planes(x) for x, _ in cells], pa.binary()), pa.array([c.tobytes() for _, c in cells], pa.binary())], names=["chunk", "range", "names", "counts"])

    def extract(batches):
        words = WordHashes()
        for b in batches:
            for ids, urls, hosts, texts, same, seen, sizes, totals in zip(*(b.column(c).to_pylist() for c in ("ids", "urls", "hosts", "pages", "same", "seen", "sizes", "totals"))):
                words.trim()
                cut = [split_page(p) for p in unsqueeze(texts)]
                tokens = [[t.split() for _, t in page] for page in cut]
                runs = Runs([[t for part in page for t in part] for page in tokens], hosts, words, run)
                total, met = own(runs, same, seen)
                total[met] = np.frombuffer(b"".join(x["totals"] for x in sorted(totals or (), key=lambda x: x["range"])), dtype=np.uint8)
                total = total[runs.at]
                need = {x["host"]: needed(x["n"]) for x in sizes}
                mirrored = np.zeros(len(ids), dtype=bool)
                mirrored[[x["pos"] for x in same or ()]] = True
                boiler = runs.covered(total >= np.array([need[h] for h in hosts])[runs.page])
                shared = runs.covered((total >= 2) | mirrored[runs.page])
                out, repeated = [], []
                for page, parts, cover, twice in zip(cut, tokens, boiler, shared):
                    main = any(v == MAIN for v, _ in page)
                    kept, n, at = [], 0, 0
                    for (v, text), part in zip(page, parts):
                        here = slice(at, at := at + len(part))
                        if v == MAIN:
                            kept.append(text)
                            n += int(twice[here].sum())
                        elif v == OTHER and not main:
                            kept.append(unique_part(part, cover[here]))
                    out.append("\n\n".join(k for k in kept if k))
                    repeated.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(repeated, pa.int64())], names=[c.split()[0] for c in OUT.split(", ")])

    # Pages of equal streams: the first of each group is counted, the others are extra.
    keys = chunks.select("chunk", F.posexplode(F.arrays_zip("hosts", "keys")).alias("pos", "x")).select("chunk", "pos", F.col("x.hosts").alias("host"), F.col("x.keys").alias("key"))
    streams = cut(keys.groupBy("host", "key").agg(F.count("*").alias("n"), F.min(F.struct("chunk", "pos")).alias("first")), "html-streams")
    here = F.struct("chunk", "pos")
    groups = cut(streams.filter("n > 1").select("host", "key", "first"), "html-copies")
    same = cut(keys.join(groups, ["host", "key"]).groupBy("chunk").agg(F.collect_list(F.struct("pos", (here != F.col("first")).alias("extra"))).alias("same")), "html-same")
    sizes = keys.select("chunk", "host").distinct().join(streams.groupBy("host").agg(F.count("*").alias("n")), "host").groupBy("chunk").agg(F.collect_list(F.struct("host", "n")).alias("sizes"))
    told = chunks.select("chunk", "hosts", "pages").mapInArrow(announce, "chunk long, range int, n int, upper binary")
    seen = cut(told.groupBy("range").applyInArrow(meet, "chunk long, range int, n int, bits binary"), "html-seen", "zstd")
    release_shuffles(spark)
    seen_by = cut(seen.groupBy("chunk").agg(F.collect_list(F.struct("range", "n", "bits")).alias("seen")).join(same, "chunk", "full"), "html-seen-by", "zstd")
    drop(seen)
    sent = chunks.select("chunk", "hosts", "pages").join(seen_by.hint("shuffle_hash"), "chunk", "left").mapInArrow(send, "chunk long, range int, names binary, counts binary")
    totals = cut(sent.groupBy("range").applyInArrow(add_up, "chunk long, range int, totals binary"), "html-totals", "zstd")
    release_shuffles(spark)
    side = totals.groupBy("chunk").agg(F.collect_list(F.struct("range", "totals")).alias("totals"))
    side = cut(sizes.join(side, "chunk", "left").join(seen_by, "chunk", "left"), "html-side", "zstd")
    drop(streams, groups, same, seen_by, totals)
    release_shuffles(spark)
    return chunks.drop("keys", "n_tokens").join(side.hint("shuffle_hash"), "chunk").mapInArrow(extract, OUT)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


QUERIES = {"op6_html_text": op6_html_text}
