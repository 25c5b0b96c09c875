"""Cases in which an operator did less than its whole job."""

import random
import zlib

import corpus_pipeline
from weir.llm import html_text, piece_lattice, quality, toxicity


def test_toxicity_of_a_minority_language(spark):
    """Insults of a language with few toxic texts become features, however many toxic texts another language has."""
    rng = random.Random(3)
    kept = [k for k in range(6000) if zlib.crc32(str(k).encode()) % 5]
    words = lambda names: " ".join(rng.choice(names) for _ in range(12))
    texts = [(k, f"{words(['plain', 'words', 'here', 'now'])}. You are vile." if n < 500 else f"{words(['agua', 'casa', 'libro'])}. Eres bobo." if n < 507 else words(["plain", "words", "agua", "casa"]), int(n < 507)) for n, k in enumerate(kept)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert {toxicity.feature(b"vile"), toxicity.feature(b"bobo")} <= set(model.weights)
    assert model.score(b"La casa. Eres bobo.") > 0.5 > model.score(b"La casa. El agua.")


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(10_000)) for _ in range(n))


def pages_of(spark, bodies):
    return spark.createDataFrame([(k, f"http://big.x/{k}", f"<body>{b}</body>") for k, b in bodies], "page_id long, url string, html string")


def test_html_runs_of_a_large_host(spark):
    """What two pages share is found wherever they stand on their host."""
    rng = random.Random(4)
    shared = [words(rng, 12) for _ in range(30)]
    pages = pages_of(spark, [(k, f"<article>{words(rng, 10)}<p>{shared[k % 350] if k % 350 < 30 else words(rng, 12)}</p></article>") for k in range(700)])
    got = {r.page_id: r.n_repeated for r in html_text.main_text(pages).collect()}
    assert got == {k: 12 if k % 350 < 30 else 0 for k in range(700)}
    assert {r.page_id: r.n_repeated for r in html_text.main_text(pages, chunk_chars=3000).collect()} == got


def test_html_runs_match_the_suffix_array(spark):
    rng = random.Random(5)
    tokens = [[rng.choice("abc") for _ in range(rng.randint(1, 60))] for _ in range(40)] + [list("abcabcabcabc")] * 2
    pages = pages_of(spark, [(k, f"<article>{' '.join(t)}</article>") for k, t in enumerate(tokens)])
    want = {k: int(c.sum()) for k, c in enumerate(html_text.repeated_tokens(tokens, 5))}
    assert {r.page_id: r.n_repeated for r in html_text.main_text(pages, run=5, chunk_chars=200).collect()} == want


def test_html_sends_little(spark, monkeypatch):
    """Texts go through no exchange, runs of one chunk aren't sent whole, and counts don't depend on how few bits are sent first."""
    rng = random.Random(7)
    shared = words(rng, 12)
    pages = pages_of(spark, [(k, f"<article>{words(rng, 30)}<p>{shared if k % 50 == 0 else words(rng, 12)}</p></article>") for k in range(300)])
    want = {k: 12 if k % 50 == 0 else 0 for k in range(300)}
    sent = []
    keep = html_text.cut
    monkeypatch.setattr(html_text, "cut", lambda df, name, *more: sent.append((name, keep(df, name, *more))) or sent[-1][1])
    monkeypatch.setattr(html_text, "drop", lambda *tables: None)
    for spare in (4, -6):
        sent.clear()
        monkeypatch.setattr(html_text, "SPARE_BITS", spare)
        got = html_text.main_text(pages, chunk_chars=3000)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Bucketed: true" in plan
        assert {r.page_id: r.n_repeated for r in got.collect()} == want
        whole = sum(len(r.totals) for name, t in sent if name == "html-totals" for r in t.collect())
        assert whole < 2500 if spare == 4 else whole > 5000  # of 10,000 runs


def test_html_mirrors_and_quotations(spark):
    """Without an article element, text that few pages share is no boilerplate; what many share, at a block's edge, is."""
    rng = random.Random(6)
    story, quote, notice, every = words(rng, 60), words(rng, 10), words(rng, 12), words(rng, 9)
    texts = {k: words(rng, 30) for k in range(40)}
    bodies = {k: f"<p>{t}</p>" for k, t in texts.items()}
    bodies[0] = bodies[1] = f"<p>{story}</p>"  # two addresses
    bodies[2] = f"<p>{story}</p><p>print</p>"  # a print version
    for k in (3, 4):
        bodies[k] = f"<p>{texts[k]} {quote} {texts[k]}</p>"
    for k in range(10, 20):
        bodies[k] = f"<p>{notice}</p><p>{texts[k]} {every} x{k} {texts[k]}</p>"
    rows = [*bodies.items(), (30, bodies[30])]  # and a repeated row
    want = {k: texts[k] for k in texts} | {0: story, 1: story, 2: f"{story}\n\nprint"} | {k: f"{texts[k]} {quote} {texts[k]}" for k in (3, 4)} | {k: f"{texts[k]} {every} x{k} {texts[k]}" for k in range(10, 20)}
    for size in (html_text.CHUNK_CHARS, 500):
        got = html_text.main_text(pages_of(spark, rows), chunk_chars=size).collect()
        assert len(got) == 41 and {r.page_id: r.text for r in got} == want


def test_quality_counts_copies(spark):
    """Copies are documents of their own in a line's count; rows of one document are not."""
    rng = random.Random(8)
    copy, twice, few = words(rng, 60), words(rng, 60), words(rng, 60)
    rows = [(k, copy, "h") for k in range(11)] + [(100, twice, "h")] * 30 + [(k, few, "h") for k in range(200, 210)] + [(None, words(rng, 60), "h")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.kept} == {None, 100, *range(200, 210)}
    assert {r.n_frequent_words for r in got if r.doc_id is not None and r.doc_id < 11} == {60}
    alone = spark.createDataFrame([(None, copy, "h")] * 21, "doc_id long, text string, source string")
    assert not any(r.kept for r in quality.quality_rules(alone).collect())


def test_quality_limit_is_a_share_of_the_host(spark):
    """A line on 30 documents is frequent in a host of 100, not in one of 4,000."""
    rng = random.Random(9)
    rows = [(k + 10_000 * h, f"Sold  by us\n{words(rng, 60)}" if k < 30 else words(rng, 52), host) for h, (host, n) in enumerate([("small", 100), ("large", 4000), (None, 31)]) for k in range(n)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got if r.n_frequent_words} == {*range(30), *range(20_000, 20_030)}
    assert all(r.kept for r in got)


def test_quality_removes_lines(spark):
    """Frequent lines go from the texts, depleted documents go whole; other columns stay as they are."""
    rng = random.Random(10)
    own = {k: words(rng, 60) for k in range(40)}
    rows = [(k, f"{own[k]}\n\nBuy  NOW, {k // 20}\n", "h", k) for k in range(30)] + [(k, f"{words(rng, 5)}\n" + "Buy now, 0\n" * 30, "h", k) for k in range(30, 35)] + [(50, "short", "h", 1), (51, None, None, 2), (None, own[39], "h", 3), (None, own[39], "h", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __weir_b int")
    got = sorted((r.doc_id, r.text) for r in quality.remove_frequent_lines(docs).collect() if r.doc_id is not None)
    assert got == [(k, f"{own[k]}\n\n" + ("" if k < 20 else "Buy  NOW, 1\n")) for k in range(30)]
    assert quality.remove_frequent_lines(docs).filter("doc_id is null").count() == 2 and quality.remove_frequent_lines(docs).columns == docs.columns
    assert quality.remove_frequent_lines(docs.limit(0)).count() == 0


def test_pipeline_decodes(spark):
    """The last stage decodes what it encodes."""
    texts = {1: "Hello  world\n\nfoo", 2: " lead", 3: "é" * 70, 4: "", 5: None, 6: "a ▁b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = corpus_pipeline.encode(spark, docs, "")
    assert {r.doc_id: (r.n_tokens > 0, r.round_trip) for r in out.collect()} == {k: (bool(t), True) for k, t in texts.items()}
    assert not piece_lattice.same_text([], "lost", [])
