"""Near duplicates in large groups, against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from weir.llm import near_duplicates
from weir.llm.common import WordHashes


def brute(texts: dict[int, str], size: int) -> dict[int, int]:
    """Smallest linked doc_id of each document, from all pairs that share a shingle."""
    words, top = WordHashes(), {k: k for k in texts}

    def root(k):
        while top[k] != k:
            top[k] = k = top[top[k]]
        return k

    sets = {k: near_duplicates.shingles(t.encode(), size, words).tolist() for k, t in texts.items()}
    holds: dict[int, list[int]] = {}
    for k, s in sets.items():
        met = Counter(m for x in s for m in holds.setdefault(x, []))
        for m, n in met.items():
            if 180 * n >= 80 * (len(s) + len(sets[m])):
                a, b = sorted((root(k), root(m)))
                top[b] = a
        for x in s:
            holds[x].append(k)
    return {k: root(k) for k in texts}


def edited(rng, words, n, names):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(names)
    return out


@pytest.mark.parametrize("group", [near_duplicates.GROUP, 20])
def test_groups_of_near_copies_lose_no_link(spark, monkeypatch, group):
    """Copies of a text around the limit, chains of copies, and texts of common shingles."""
    monkeypatch.setattr(near_duplicates, "GROUP", group)
    rng = random.Random(11)
    names = [f"w{k}" for k in range(400)]
    base = [f"b{k}" for k in range(120)]
    texts = {k: " ".join(edited(rng, base, rng.randint(0, 9), names)[: rng.choice([120, 120, 110, 100])]) for k in range(1500)}
    link = base
    for k in range(1500, 1600):  # each a little further from the base than the one before
        link = edited(rng, link, 1, names)
        texts[k] = " ".join(link)
    for k in range(1600, 2000):
        texts[k] = " ".join(rng.choice(["la", "le", "li", "lo", "lu"]) for _ in range(rng.randint(20, 60)))
    want = brute(texts, 4)
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").repartition(4)
    assert len(set(want.values())) > 100
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs, 4).collect()} == want


def test_long_lists_become_groups(spark, monkeypatch):
    """Lists above the limit go through further rounds with centres of their own."""
    monkeypatch.setattr(near_duplicates, "SHORT", 16)
    monkeypatch.setattr(near_duplicates, "GROUP", 0)
    rng = random.Random(12)
    base = [f"b{k}" for k in range(80)]
    texts = {k: " ".join(edited(rng, base, rng.randint(2, 7), ["x", "y"])) for k in range(200)}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs, 4).collect()} == brute(texts, 4)


def test_rows_of_one_doc_id(spark):
    """Rows of a doc_id count by their own texts; one row of each group stays."""
    a, b, c = (" ".join(f"{p}{k}" for k in range(40)) for p in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b.upper()), (4, c), (4, c), (5, ""), (5, None), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs, 4).collect())
    assert got == Counter({(1, 37, 1, True): 2, (2, 37, 1, False): 1, (3, 37, 1, False): 1, (4, 37, 4, True): 2, (5, 0, 5, True): 2, (None, 37, None, True): 1})
    kept = Counter((r.doc_id, r.text) for r in near_duplicates.keep_one_of_each(docs, 4).collect())
    assert sum(kept.values()) == 5 and kept >= Counter([(1, a), (1, b), (4, c), (None, c)])


def test_bound_of_the_prefix():
    """held_in counts the common elements of sorted sets."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, c = (np.unique(rng.integers(0, 40, 20).astype(np.uint64)) for _ in "ab")
        assert int(near_duplicates.held_in(x, c).sum()) == len(np.intersect1d(x, c))
