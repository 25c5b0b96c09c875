"""Every operator against brute force or the library, on odd rows: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from weir.llm import decontaminate, html_text, near_duplicates, piece_lattice, quality, sharding, substrings, token_counts, token_output, toxicity
from weir.llm.graph import components

R = random.Random(7)
VOCAB = [R.choice("abcdé") + R.choice("xyz") + str(k % 7 or "") for k in range(60)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


LONG = prose(3000)
BASE = prose(120)
TEXTS = [None, "", "  \n", "One", BASE, BASE, BASE.replace(" ", "\n", 3), BASE + " tail words", prose(60) + " " + BASE[:400], LONG, "A,b. C! <d> 😀\t" * 20, prose(80), prose(80), "the " * 120, "x" * 3000]
ROWS = [(k, t, "s", k, "u") for k, t in enumerate(TEXTS)] + [(4, BASE, "s", 4, "u"), (None, BASE, None, 0, "u"), (None, None, None, 0, "u")]
SCHEMA = "doc_id long, text string, source string, uid long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(10, " ".join(BASE.split()[5:30]).upper().replace("É", "é")), (9, "one"), (8, None), (7, "..."), (9, "one")], "item_id long, text string")
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    wins = {}
    for i, t in ((10, items.collect()[0][1]), (9, "one")):
        w = words(t)
        for k in range(max(1, len(w) - 9)):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for i, t, *_ in ROWS:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    assert rows(decontaminate.contamination(docs, items).drop("items")) == sorted(want, key=repr)
    index = decontaminate.build_index(docs, 10, 500, reach=12)
    one = rows(decontaminate.search(index, items, 10).select("doc_id", "hits", F.sort_array("items")))
    assert rows(decontaminate.search(decontaminate.build_index(docs, 10), items, 10).select("doc_id", "hits", F.sort_array("items"))) == one
    assert rows(decontaminate.search(index, items, 10, slop=12).filter("size(hits) > 0")) and rows(decontaminate.contamination(none, items)) == []
    with pytest.raises(ValueError):
        decontaminate.search(decontaminate.build_index(docs, 10), items, 10, slop=12)
    assert all(r[2] == 0 for r in rows(decontaminate.contamination(docs, items.limit(0))))


def test_proximity(spark):
    """Windows whose words all lie near an occurrence of their rarest one, never across documents, against brute force."""
    rng = random.Random(21)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 25))] for _ in range(60)]
    asked = [["a", "b", "c"], ["c", "h", "g"], ["d", "d", "e"], ["f"], ["a", "zzz", "b"]]
    freq = {w: sum(t.count(w) for t in texts) for w in "abcdefgh"}
    for slop in (1, 3, 6):
        want = set()
        for d, t in enumerate(texts):
            for i, ws in enumerate(asked):
                if all(w in freq for w in ws):
                    rare = min(range(len(ws)), key=lambda k: (freq[ws[k]], k))
                    if any(t[p] == ws[rare] and all(w in t[max(0, p - slop) : p + slop + 1] for w in ws) for p in range(len(t))):
                        want.add((d, str(i)))
        docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
        items = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(asked)], "item_id long, text string")
        index = decontaminate.build_index(docs, 3, 100, reach=slop)
        assert {(r.doc_id, i) for r in decontaminate.search(index, items, 3, slop=slop).collect() for i in r["items"]} == want


def test_token_counts(docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = sorted([(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in ROWS], key=repr)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time from the cache alone
        assert rows(token_counts.token_counts(docs, path, cache)) == want
    assert docs.sparkSession.read.parquet(cache).groupBy("digest", "version").count().filter("count > 1").count() == 0
    before = docs.sparkSession.read.parquet(cache).count()
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(900, "a text of its own"), (901, "a text of its own"), (902, "A  text of its own")], "doc_id long, text string"))
    got = rows(token_counts.token_counts(more, path, cache))
    assert sorted([*want, *[(k, n, 5, False) for k, n in ((900, 17), (901, 17), (902, 18))]], key=repr) == got
    assert docs.sparkSession.read.parquet(cache).count() == before + 2  # only what is new was encoded and appended
    assert rows(token_counts.token_counts(none, path)) == []
    assert not token_counts.drops_white_space(P.path("byte_bpe_50k.json"))


def test_token_count_cache_is_kept_for_each_input(spark, tmp_path):
    one, two = (str(tmp_path / x) for x in ("one", "two"))

    def write(at, *texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("append").parquet(f"{at}/documents.parquet")

    def run(at):
        """What the run appends to the cache, and its token counts."""
        kept = lambda: spark.read.schema(token_counts.CACHE).parquet(token_counts.cache_of(spark, at))
        before = kept().count() if os.path.exists(token_counts.cache_of(spark, at).removeprefix("file://")) else 0
        counts = [n for _, _, n, _ in rows(token_counts.op2_token_counts(spark, at))]
        return kept().count() - before, counts

    for at in (one, two):
        write(at, "one text", "another text here", None, "one  text")
        assert run(at) == (3, [2, 3, 0, 2]), "an input's run counts all its texts, whatever was run on others"
    write(one, "a text no other row has")
    assert run(one + "/") == (1, [6, 2, 3, 0, 2]), "a second run counts new texts only"


def test_sharding(spark, docs, none):
    many = docs.unionByName(spark.createDataFrame([(100 + k, f"t{k % 9}" if k % 3 else "hot", "s", 0, "u") for k in range(200)] + [(1000 + k, f"alone {k}", "s", 0, "u") for k in range(400)], SCHEMA))
    out = sharding.shard_documents(many, 5).collect()
    sizes = [sum(r.shard == s for r in out) for s in range(5)]
    assert len(out) == many.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s])) for s in range(5))
    crc = {i: (zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t, *_ in ROWS if i is not None}
    assert all((r.text_crc32, r.size) == crc[r.doc_id] for r in out if r.doc_id in crc)
    group = {r.doc_id: r.shard for r in out}
    assert sum(len({group[100 + k] for k in range(200) if k % 3 and k % 9 == m}) - 1 for m in range(9) if m % 3) <= 4
    assert rows(sharding.shard_documents(none, 5)) == []


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    assert dict(components(edges).collect()) == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_groups(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
        w = space_words(w)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, docs, none):
    want = brute_groups([(i, t) for i, t, *_ in ROWS if i is not None], 4, 80)
    for r in near_duplicates.near_duplicates(docs, 4).collect():
        assert r.component_id is None and r.kept if r.doc_id is None else (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert rows(near_duplicates.near_duplicates(none)) == []
    base = [R.choice(VOCAB) + str(k) for k in range(100)]
    group = []
    for i in range(60):  # a group of which some members only link by others
        w = list(base)
        for k in R.sample(range(100), R.randint(0, 5)):
            w[k] = f"new{R.random()}"
        group.append((i, " ".join(w)))
    want = brute_groups(group, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(spark.createDataFrame(group, "doc_id long, text string"), 4).collect()}
    assert got == want and len({c for _, c in want.values()}) > 1


def test_sketch_agreement():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    agree = np.mean([np.mean(near_duplicates.sketch(near_duplicates.mix(a * np.uint64(k))) == near_duplicates.sketch(near_duplicates.mix(b * np.uint64(k)))) for k in range(3, 43, 2)])
    assert abs(agree - 800 / 1200) < 0.05
    assert all((near_duplicates.sketch(a[:n]) < (1 << 64) - 1).all() for n in (1, 2, 50))


def test_toxicity(spark, none):
    texts = [(k, f"Plain words {prose(20)}. " + (f"You are {R.choice(['vile', 'foul'])} {prose(3)}. " if k % 4 == 0 else "") + prose(10)) for k in range(400)]
    docs = spark.createDataFrame([*texts, (None, "foul"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    model = toxicity.train(docs, labels)
    bad = toxicity.offending_sentences(docs, model).collect()
    assert bad and all("vile" in r.sentence or "foul" in r.sentence for r in bad)
    assert rows(toxicity.toxicity(docs.limit(0), labels)) == [] and all(r.score == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_html(spark):
    shop = "<div>Cheap offers of the day for all our loyal friends and readers</div>"
    pages = [
        (1, "http://a.x/1", "<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Big &amp; small</h1><p>One\n two<br>three<p>Four <b>bold</b><script>x('</p>')</script><div class=comments><p>me too</p></div></article><footer>end</footer>"),
        (2, "http://a.x/2", f"<body><form>in</form>{shop}<p>Only here stands this unique sentence.</p>"),
        (3, "http://a.x/3", f"<body>{shop}<p>Another sentence that nobody else has.</p>"),
        (4, None, None), (5, "http://b.x", ""), (5, "http://b.x", ""), (6, "http://b.x/6", "<p>a < b &lt;c&gt; <i>d"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {1: "Big & small\n\nOne two three\n\nFour bold", 2: "Only here stands this unique sentence.", 3: "Another sentence that nobody else has.", 4: "", 5: "", 6: "a < b <c> d"}
    assert html_text.main_text(df).count() == 7 and html_text.main_text(df.limit(0)).count() == 0


def test_html_class_words():
    """Class names count whole: a layout without a sidebar is no sidebar; small print inside an article is part of it."""
    kept = lambda page: [t for v, t in html_text.blocks(page) if v]
    for name in ("no-sidebar", "has-sidebar content", "without_menu", "sidebar-none", "article-body", "adverbs", "page-content", "js-no-ads"):
        assert kept(f'<div id="content" class="{name}"><p>The story.</p></div>') == ["The story."]
    for name in ("sidebar", "left-sidebar", "cookie-notice", "ad", "ad-slot-300x250", "site_footer", "share-buttons", "related-posts", "cookieConsent", "comments-area", "main-nav"):
        assert kept(f'<article><p>The story.</p><div class="{name}"><p>Not it.</p></div></article>') == ["The story."]
    assert kept('<article><p>Story.</p><p class="legal">Terms of the deal.</p><p class="search-result">Found.</p></article><p class="legal">Legal.</p>') == ["Story.", "Terms of the deal.", "Found."]


def test_suffix_array():
    pages = [[R.choice("abc") for _ in range(R.randint(0, 40))] for _ in range(12)]
    got, run = html_text.repeated_tokens(pages, 5), 5
    for k, p in enumerate(pages):
        want = np.zeros(len(p), dtype=bool)
        for i in range(len(p) - run + 1):
            if any(p[i : i + run] == q[j : j + run] for m, q in enumerate(pages) if m != k for j in range(len(q) - run + 1)):
                want[i : i + run] = True
        assert (got[k] == want).all()


def test_quality(spark, docs, none):
    want = []
    for i, t, *_ in ROWS:
        w, seen, dup = space_words(t), set(), 0
        for line in (t or "").split("\n"):
            if space_words(line):
                dup, _ = dup + (line in seen), seen.add(line)
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        cover = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(3)} if len(w) < 1000 or i is None else None
        want.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, None if cover is None else len(cover)))
    got = quality.quality_rules(docs).collect()
    for g, x in zip(sorted(got, key=lambda r: repr(tuple(r)[:5])), sorted(want, key=lambda r: repr(r[:5]))):
        assert tuple(g)[:5] == x[:5] and x[5] in (None, g.n_repeat_words)
        assert g.base_failed == (g.n_words < 50 or 2 * g.n_repeat_words > g.n_words) and (g.kept <= (not g.base_failed))
    line = prose(60)
    site = spark.createDataFrame([(k, f"{line}\n{prose(9)} {k}", "h") for k in range(30)] + [(99, prose(70), "h"), (98, line, "other")], "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.quality_rules(site, least=20, max_share=0.0, max_repeat=1.0).collect() if r.kept}
    assert kept == {98, 99} and rows(quality.quality_rules(none)) == []


def test_token_output(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    ids = token_output.ids_table(docs, path, 2)
    token_output.write_ids(ids, str(tmp_path / "f"))
    got = sorted(token_output.read_digests(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t in sorted(((i if i is not None else -1, t or "") for i, t, *_ in ROWS), key=lambda x: x)]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in want]
    assert [r.start for r in got] == [sum(map(len, want[:k])) for k in range(len(want))]
    assert sorted(map(list, (r.ids for r in token_output.read_documents(spark, str(tmp_path / "f")).collect()))) == sorted(want)
    token_output.write_ids(token_output.ids_table(none, path, 2), str(tmp_path / "e"))
    assert token_output.read_digests(spark, str(tmp_path / "e")).count() == 0


def test_encoder_cuts_where_the_library_does():
    encode = token_output.Encoder(P.path("byte_bpe_50k.json"))
    texts = ["foo's. it's) 'tis, don't!", "a.b. c,,, d.) e'.) x'll.", "<|endoftext|>. a<|endoftext|>.", "é. ñ! ß? ǆ) ɐ. 日本。 日.", "a.\nb,\n\nc;", "x. .x ... x... (x). [y], 3. 3a. a3.", "á. c_ _c _", "a  b. ", "", "?", "a\n."]
    texts += [a + m + b for a in ("x", "3", "é", "'s", "") for m in (".", ",)", "'.", "_!") for b in ("", " y.", "\ny!", "z")]
    for _ in range(2):  # the second time all parts are known
        assert encode(texts) == encode.whole(texts)
    encode.known, encode.older = {}, encode.known
    assert encode(texts) == encode.whole(texts)


def test_encoder_looks_up_only_what_it_needs():
    class Remembered(dict):
        def __iter__(self):
            raise AssertionError("goes through all that is remembered")

    encode = token_output.Encoder(P.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{k}x{j}" for j in range(5)) for k in range(60)] + ["", "w0x1 <|endoftext|>."]
    want = encode(texts)
    assert want == encode.whole(texts)
    encode.known, encode.older = {}, Remembered(encode.known)
    assert encode(texts[:3] + texts[-1:] + ["neu"]) == want[:3] + want[-1:] + encode.whole(["neu"])


def test_length_limited_code():
    counts = np.array([2**k for k in range(30)])
    bits = token_output.code_lengths(counts, 12)
    assert bits.max() <= 12 and sum(2.0 ** -b for b in bits.tolist()) <= 1 and list(bits) == sorted(bits, reverse=True)


def test_substrings(docs, none):
    named = [(i, space_words(t)) for i, t, *_ in ROWS if i is not None]
    first = {}
    for i, w in named:
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = []
    for i, t, *_ in ROWS:
        w = space_words(t)
        gone = {k + j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(50)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert rows(substrings.removed_counts(substrings.find_repeats(docs))) == sorted(want, key=repr)
    kept = {r.doc_id: r.text for r in substrings.remove_repeats(docs).collect()}
    assert 5 not in kept and kept[4] == BASE and kept[7] == "tail words" and kept[0] is None
    assert rows(substrings.removed_counts(substrings.find_repeats(none))) == []


@pytest.mark.parametrize("period", substrings.COVERS)
def test_difference_cover(period):
    cover = substrings.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("head", [300_000, 3])
def test_pieces(spark, docs, none, head):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    more = ["Hello  world\n\nfoo", " lead", "a\tb", "　x y", "trail  ", "</s> <unk> <0x0A>", "▁▁a ▁b", "\n" + "é" * 70, "12.5% of a.b..c", "ﾊ"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    want = sorted(((i, sp.encode(t or "")) for i, t in [(i, t) for i, t, *_ in ROWS] + [(100 + k, t) for k, t in enumerate(more)]), key=repr)
    ids = piece_lattice.encode_documents(df, model, head)
    assert sorted(((r.doc_id, list(r.ids)) for r in ids.collect()), key=repr) == want
    back = {r.doc_id: r.text for r in piece_lattice.decode_documents(ids, model).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in df.collect() if i is not None)
    assert rows(piece_lattice.encode_documents(none, model, head)) == []


def test_piece_cuts():
    """The ids of the parts, one after the other, are those of the whole text, and no wanted substring is left out."""
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp, pieces, rng = sentencepiece.SentencePieceProcessor(model_file=model), piece_lattice.load(model), random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(["the", "tion", "ción", "ß", "²", ".", ",", "'s", " ", "  ", "\n", "\t", "é", "7", "_", "Ñ", "語", "🙂", "▁", "-"]) for _ in range(rng.randint(1, 30)))
        parts = [p for c in pieces.chunks(text) for p in pieces.parts(c)]
        mark = np.array([sp.piece_to_id("▁")], dtype=pieces.type).tobytes()  # the library drops a mark that stands alone
        assert b"".join(mark if p == "▁" else piece_lattice.long_chunk(sp, p, pieces.type) for p in parts) == np.array(sp.encode(text), dtype=pieces.type).tobytes()
        for p in parts:
            found = {(s, k) for s in range(len(p)) for k in range(2, len(p) - s + 1) if p[s : s + k] in pieces.names}
            assert len(p) > piece_lattice.LONG or found == {(x >> 6, x & 63) for x in pieces.spans(p) if x != 1}


def test_piece_bytes_and_spans(spark):
    """Texts are compressed before they are exchanged, whole; spans and ids of many chunks at once are those of each."""
    import pyarrow as pa
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp, pieces = sentencepiece.SentencePieceProcessor(model_file=model), piece_lattice.load(model)
    texts = [None, "", "é 語 🙂 " * 400, BASE]
    out = next(piece_lattice.squeezed([pa.RecordBatch.from_pydict({"doc_id": [1, None, 2, 3], "key": [1, 2, 3, 4], "text": pa.array(texts, pa.string())})]))
    assert [piece_lattice.codec().decompress(t.as_py(), n.as_py()).to_pybytes().decode() for t, n in zip(out["text"], out["n"])] == [t or "" for t in texts]
    assert sum(map(len, out["text"].to_pylist())) < sum(len((t or "").encode()) for t in texts) / 2
    chunks = sorted({c for t in texts for c in pieces.chunks(t)})
    at, spans = pieces.all_spans(chunks)
    for c, a, b in zip(chunks, at.tolist(), at[1:].tolist()):
        assert {(x >> 6, x & 63) for x in spans[a:b].tolist() if x != 1} == {(s, k) for s in range(len(c)) for k in range(2, len(c) - s + 1) if c[s : s + k] in pieces.names}
    for t in texts[2:]:
        ids = np.array(sp.encode(t))
        assert piece_lattice.decoded(ids, pieces).decode() == t == sp.decode(ids.tolist())
    assert pieces.units("▁eton" + "ètre") == ["▁etonètre"] and pieces.units("é" * 49) == pieces.parts("é" * 49)


def test_encoder_cuts_near_characters_as_the_library_does():
    """Every character below U+0250 alone, beside letters, digits, signs and itself; and at random."""
    rng = random.Random(11)
    encode = token_output.Encoder(P.path("byte_bpe_50k.json"))
    near = [chr(c) for c in range(0x250) if chr(c).isprintable() and chr(c) != " "]
    texts = [f"{c} {c}{c} a{c} {c}a 3{c} {c}3 .{c} {c}. '{c}\n{c}s\né{c} {c}x" for c in near]
    pick = near + list("'sstremvld.,é3") * 20 + ["’", "ɐ", "日", "Ж", "٣"]
    texts += ["".join(rng.choice(pick) for _ in range(rng.randint(1, 12))) + rng.choice(["", " x", "\ny", " <|endoftext|>b"]) for _ in range(5000)]
    assert all(map(token_output.plain, texts)) and encode(texts) == encode.whole(texts)


def test_encoder_sends_only_far_characters_through_the_pre_tokenizer():
    encode = token_output.Encoder(P.path("byte_bpe_50k.json"))
    texts = ["Plain words, don't stop. Größe\nÉtat 32", "far ’quoted’ 日本 here"]
    want, sent, tok = encode.whole(texts), [], encode.tok

    class Heard:
        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return tok.encode_batch_fast(texts, **more)

    encode.tok = Heard()
    assert encode(texts) == want
    assert sorted("".join(sent).split()) == ["’quoted’", "日本"]
