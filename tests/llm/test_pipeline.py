"""The pipeline's stages on rows whose fate is known."""

import glob
import os
import random

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(5000)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(31), tmp_path_factory.mktemp("tables")
    clean = {k: prose(rng, 120) for k in range(100)}
    texts = dict(clean)
    for k in range(100, 200):
        texts[k] = f"{prose(rng, 30)}. You are a vile foul wretch. {prose(rng, 20)}"
    passage, leak = prose(rng, 60), prose(rng, 14)
    for k in range(200, 210):  # near copies of clean documents
        w = clean[k - 200].split()
        texts[k] = " ".join([*w[:-3], "new", "last", "words"])
    for k in (300, 301, 302):
        texts[k] = f"{prose(rng, 100)} {passage} {prose(rng, 100)}"
    for k in (400, 401):
        texts[k] = f"{prose(rng, 50)} {leak.upper()} {prose(rng, 50)}"
    texts |= {500: "", 501: None, 502: "ß " * 300 + prose(rng, 20_000)}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    rows += [(0, texts[0], "en", "s", 1), (None, clean[50], "en", "s", 1), (None, texts[400], "en", "s", 1), (300, texts[401], "en", "s", 1), (7, prose(rng, 80), "en", "other", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(100 <= k < 200)) for k in range(200)] + [(None, 1, 1), (9999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, passage


def read(spark, tables):
    return spark.read.parquet(f"{tables[0]}/documents.parquet")


def ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in df.collect())


def test_toxic_documents_go(spark, tables):
    out = corpus_pipeline.drop_toxic(spark, read(spark, tables), tables[0])
    assert ids(out) == ids(read(spark, tables).filter("doc_id is null or doc_id not between 100 and 199")) and out.columns == read(spark, tables).columns


def test_one_near_copy_stays(spark, tables):
    docs = read(spark, tables).filter("doc_id is null or doc_id not between 100 and 199")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_near_duplicate(spark, docs, tables[0]).collect()]
    want = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or not 200 <= r.doc_id < 210]
    want.remove((0, tables[1][0]))  # a repeated row
    want.remove((401, tables[1][401]))  # its text stands under doc_id 300 as well
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_repeats_are_cut(spark, tables):
    docs = read(spark, tables).filter("doc_id in (300, 301, 302, 5, 500, 501) and text not like '%ß%' or text is null").filter("n_chars > 1 or n_chars = 0")
    out = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, tables[0]).collect()}
    assert tables[2] in out[300].text and all(tables[2] not in out[k].text and len(out[k].text.split()) == 200 for k in (301, 302))
    assert out[5].text == tables[1][5] and out[500].text == "" and out[501].text is None and out[301].n_chars == len(out[301].text)


def test_contaminated_rows_go(spark, tables):
    out = corpus_pipeline.drop_contaminated(spark, read(spark, tables), tables[0])
    gone = [(r.doc_id, r.text) for r in read(spark, tables).exceptAll(out).collect()]
    assert sorted(gone, key=repr) == sorted([(400, tables[1][400]), (401, tables[1][401]), (None, tables[1][400]), (300, tables[1][401])], key=repr)


def test_run(spark, tables):
    """Clean documents come out, encoded, and nothing but the result is left behind."""
    out = corpus_pipeline.run(spark, tables[0])
    got = ids(out)
    assert set(range(100)) <= set(got) and {-1, 300, 301, 302, 500, 501, 502} <= set(got) and not set(got) & {*range(100, 210), 400, 401}
    assert all(r.round_trip for r in out.collect())
    left = glob.glob(os.path.join(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "weir-tables", spark.sparkContext.applicationId, "pipeline-*"))
    assert len(left) == 1
    empty = read(spark, tables).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables[0]).count() == 0
