"""What workers hold as Python objects doesn't grow with the rows of a batch."""

import tracemalloc

import pyarrow as pa

from weir.llm import near_duplicates, substrings, toxicity


def test_profile_holds_few_texts_at_once():
    texts = [" ".join(f"{k}w{j}" for j in range(200)).encode() for k in range(3_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_000)), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    del texts
    tracemalloc.start()
    try:
        out = list(substrings.profile([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 3_000 and all(n == 200 for b in out for n in b.column("n_words").to_pylist())
    assert peak < 4 << 20, peak


def peak_of(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def many_words(batches=8, texts=256, words=500):
    """A million different words."""
    for b in range(batches):
        yield [" ".join(f"{b}x{k}w{j}" for j in range(words)).encode() for k in range(texts)]


def long_words():
    for b in range(16):
        yield [f"{b}x{k}".encode() + b"y" * (1 << 20) for k in range(4)]


def test_sketches_remember_little():
    """Several workers of an executor hold hashed words at once, beside the JVM's heap."""
    seen = []

    def run(lists):
        batches = (pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(range(len(t))), pa.array(t, pa.binary())], names=["doc_id", "text_key", "text"]) for t in lists)
        seen.append(sum(b.num_rows for b in near_duplicates.sketches(5)(batches)))

    assert peak_of(lambda: run(many_words())) < 64 << 20
    assert peak_of(lambda: run(long_words())) < 32 << 20
    assert seen == [8 * 256, 16 * 4]


def test_toxicity_remembers_little():
    model = toxicity.Model({toxicity.feature(b"vile"): 9.0}, -6.0)
    assert peak_of(lambda: [model.score(t.replace(b"0", b"a")) for texts in long_words() for t in texts]) < 32 << 20
    letters = bytes.maketrans(b"0123456789", b"abcdefghij")
    assert peak_of(lambda: [model.score(t.translate(letters)) for texts in many_words() for t in texts]) < 64 << 20
    assert model.score(b"You are vile.") > 0.5 > model.score(b"You are kind.")
