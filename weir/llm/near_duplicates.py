"""Near-duplicate groups by fast similarity sketching (op 4).

A text's set holds its distinct shingles (hashes of consecutive words). The
sketch has ``T`` coordinates and is filled in rounds: round i throws every
element at a bin with a value, and a bin keeps the least (round, value). In
the first T rounds the bin is hashed; in the next T rounds all elements go to
bin i - T, so every coordinate fills for certain, while an element count well
above T fills nearly all in the first round. Two sets agree in a coordinate
with their Jaccard similarity as the chance, with the concentration of
independent trials. (Dahlgaard, Knudsen and Thorup, "Fast Similarity
Sketching", 2017.)

``BANDS`` bands of ``T / BANDS`` coordinates make buckets: a pair of
similarity 0.8 shares none with a chance below 1e-7. Only then come full sets:

1. texts with one set collapse to a class;
2. each bucket takes as its centre the member whose buckets hold the most
   others (in a group of copies of one text, that text or what is closest to
   it), and every member is compared with it on full sets: links, and what
   each member shares with the centre. Buckets of one centre are one group;
3. what a member shares with its centre bounds what it can share with any
   other member, so in groups that still hold several components only members
   that meet outside the centre's set (``candidates``) can be linked. Such
   members form lists by the rare shingles they share; short lists are compared
   member by member, long ones become groups with centres of their own, until
   none is left.

No step forms all pairs of a group, and none drops a pair that could be linked.

Edge cases: without words or text the set is empty and links with nothing
(component_id = doc_id); fewer words than a shingle make one shingle; a null
doc_id links with nothing (component_id null, kept); rows repeating a doc_id
each get a row, by their own text; an empty table gives an empty result; other
columns are not read. Texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, batches_of, cut, docs_view, drop, list_column, mix, read, release_shuffles, slices
from .graph import components

#: Coordinates of a sketch, bands, members of a list that are compared with each other (twice as many in each later round, so rounds end).
T, BANDS, SHORT = 128, 32, 256
SKETCH = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"
SHARED = "c long, x long, n long, n_c long, both long, rest array<long>"
#: Groups up to so many members and elements outside the centre are searched by one task; larger ones by joins. The outcome is the same.
GROUP, VOLUME = 400, 1 << 20
ROUND_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: bytes | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, dtype=np.uint64)
    words.trim()
    h = words.of(parts)
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(parts) if len(parts) < size else size, dtype=np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set."""
    low = np.uint64((1 << 55) - 1)
    bins = np.full(T, (1 << 64) - 1, dtype=np.uint64)
    step = max(1, min(2 * T, 4096 // len(s)))  # rounds taken at once; the outcome is the same
    for r in range(0, 2 * T, step):
        rounds = np.arange(r, min(r + step, 2 * T))
        h = mix(s[None, :] ^ ROUND_SEEDS[rounds][:, None])
        at = (h >> np.uint64(57)).astype(np.int64)
        late = rounds >= T
        at[late] = (rounds[late] - T)[:, None]
        np.minimum.at(bins, at.ravel(), ((rounds.astype(np.uint64) << np.uint64(55))[:, None] | (h & low)).ravel())
        if bins.max() < (rounds[-1] + 1) << 55:  # every bin has a value of a round so far
            break
    return bins


def band_keys(s: np.ndarray) -> np.ndarray:
    c = sketch(s).reshape(BANDS, T // BANDS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(c.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c[:, k])
    return key


def sketches(size: int):
    def run(batches):
        words, none = WordHashes(), np.empty(0, dtype=np.int64)
        for b in slices(batches):
            sets = [shingles(t, size, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), list_column([band_keys(s).view(np.int64) if len(s) else none for s in sets], pa.int64())],
                names=[c.split()[0] for c in SKETCH.split(", ")],
            )

    return run


def set_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def held_in(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which elements of x the sorted, non-empty set c holds."""
    return c[np.minimum(np.searchsorted(c, x), len(c) - 1)] == x


def full_sets(texts: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(key, n, elems) of the classes, from the text of one document of each."""

    def run(batches):
        words = WordHashes()
        for b in slices(batches):
            sets = [shingles(t, size, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "n", "elems"])

    one = texts.join(classes.select("doc_id", "text_key", "key"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    with batches_of(texts.sparkSession, 1_000):
        return cut(one.select("key", "text").mapInArrow(run, "key long, n long, elems binary"), "near-sets")


def shared(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """For each member x of centre c: sizes, elements in common, and the elements of x that c lacks."""

    def run(batches):
        for b in batches:
            n, both, rest = [], [], []
            for x, c in zip(b.column("elems").to_pylist(), b.column("elems_c").to_pylist()):
                x = set_of(x)
                hit = held_in(x, set_of(c))
                n.append((len(x), len(c) >> 3))
                both.append(int(hit.sum()))
                rest.append(x[~hit].view(np.int64))
            size = np.array(n, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("x"), pa.array(size[:, 0]), pa.array(size[:, 1]), pa.array(both, pa.int64()), list_column(rest, pa.int64())], names=[c.split()[0] for c in SHARED.split(", ")])

    pairs = groups.join(sets.select(F.col("key").alias("x"), "elems"), "x").join(sets.select(F.col("key").alias("c"), F.col("elems").alias("elems_c")), "c")
    with batches_of(sets.sparkSession, 500):
        return cut(pairs.select("c", "x", "elems", "elems_c").mapInArrow(run, SHARED), "near-shared")


def only(sets: DataFrame, pairs: DataFrame, one: str, two: str) -> DataFrame:
    """The sets that the pairs name, written: later joins move these alone."""
    ids = cut(pairs.select(F.col(one).alias("key")).union(pairs.select(two)).distinct(), "near-ids")
    return cut(sets.join(ids, "key", "left_semi"), "near-some")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sets = only(sets, pairs, "a", "b")

    def run(batches):
        for x in batches:
            ok = []
            for s, t in zip(x.column("s").to_pylist(), x.column("t").to_pylist()):
                s, t = set_of(s), set_of(t)
                ok.append((100 + percent) * int(held_in(s, t).sum()) >= percent * (len(s) + len(t)))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("elems").alias("s")), "a").join(sets.select(F.col("key").alias("b"), F.col("elems").alias("t")), "b")
    with batches_of(sets.sparkSession, 500):
        return cut(both.mapInArrow(run, "a long, b long"), "near-links")


def least_common(n, m, percent: int):
    """The fewest common elements of linked sets of n and m elements."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent) - 1e-9)


def open_pairs(percent: int):
    """Pairs of one group's members that could be linked and are not yet joined, from the exact counts of what they share outside the centre."""

    def run(group: pa.Table) -> pa.Table:
        x, component, n, both = (group.column(c).to_numpy() for c in ("x", "component", "n", "both"))
        rest = group.column("rest").combine_chunks()
        flat, m = rest.flatten().to_numpy(), len(x)
        who = np.repeat(np.arange(m), np.diff(rest.offsets.to_numpy()))
        _, at, df = np.unique(flat, return_inverse=True, return_counts=True)
        some = df[at] > 1
        who, (_, at) = who[some], np.unique(at[some], return_inverse=True)
        met = np.zeros((m, m), dtype=np.float32)
        order = np.argsort(at)
        who, at = who[order], at[order]
        for k in range(0, int(at.max(initial=-1)) + 1, 4096):
            here = slice(*np.searchsorted(at, (k, k + 4096)))
            holds = np.zeros((m, 4096), dtype=np.float32)
            holds[who[here], at[here] - k] = 1
            met += holds @ holds.T
        size = n[:, None] + n[None, :]
        able = (100 + percent) * (np.minimum(both[:, None], both[None, :]) + met) >= percent * size
        able &= (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])) & (component[:, None] != component[None, :])
        a, b = np.nonzero(np.triu(able, 1))
        return pa.table([pa.array(np.minimum(x[a], x[b])), pa.array(np.maximum(x[a], x[b]))], names=["a", "b"])

    return run


def candidates(shared: DataFrame, found: DataFrame, percent: int, short: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare, and lists (c, s, x) too long for that: together all pairs of a group that could be linked and are not yet joined.

    Two members x and y of centre c have at most min(both_x, both_y) elements
    in common inside c. Small groups count what they share outside. In large
    ones, the least size gives the fewest elements x must have in common with
    any partner, and thus how many (``miss``) must lie outside c. Under one
    order of elements, rare ones first, the first |rest| - miss + 1 of what
    lies outside must then meet (prefix filter). Pairs that need nothing
    outside c are found by size classes (``border``).
    """
    of = found.select(F.col("node").alias("x"), "component")
    rows = shared.join(of, "x", "left").withColumn("component", F.coalesce("component", "x"))
    mixed = rows.groupBy("c").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), ((F.count("*") <= GROUP) & (F.sum(F.size("rest")) <= VOLUME)).alias("small")).filter("lo < hi")
    rows = cut(rows.join(mixed.select("c", "least", "small"), "c"), "near-mixed")
    pairs = rows.filter("small").select("c", "x", "n", "both", "component", "rest").groupBy("c").applyInArrow(open_pairs(percent), "a long, b long")
    rows = rows.filter("not small")
    if not rows.take(1):
        return cut(pairs.distinct(), "near-pairs"), shared.select("c", F.lit(0).alias("s"), "x").limit(0)
    need = least_common(F.col("n"), F.greatest("least", F.ceil(percent * F.col("n") / F.lit(100) - 1e-9)), percent)
    rows = rows.withColumn("miss", need - F.col("both"))
    size = F.size("rest")
    outside = rows.select("c", "x", "component", size.alias("size"), (size - F.greatest("miss", F.lit(1)) + 1).alias("first"), F.explode("rest").alias("s")).filter("first > 0")
    often = outside.groupBy("c", "s").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("df > 1")
    met = outside.select("c", "s", "x", "size", "first").join(cut(often, "near-often"), ["c", "s"])
    mine = Window.partitionBy("c", "x")
    # Elements of x alone come first of all; they need no row.
    place = F.col("size") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "s"))
    keys = met.withColumn("place", place).filter("place <= first and lo < hi").select("c", "s", "x").join(rows.select("c", "x", "n", "component"), ["c", "x"])
    keys = cut(keys, "near-keys")
    lists = keys.groupBy("c", "s").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    keys = keys.join(cut(lists.select("c", "s", "members"), "near-lists"), ["c", "s"])
    left, right = (keys.filter(F.col("members") <= short).select("c", "s", *[F.col(k).alias(f"{k}_{side}") for k in ("x", "n", "component")]) for side in "ab")
    close = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and component_a <> component_b"
    pairs = pairs.union(left.join(right, ["c", "s"]).filter("x_a < x_b").filter(close).select(F.col("x_a").alias("a"), F.col("x_b").alias("b")))
    # Of two border members the larger, or one that c's component doesn't hold, is looked up by the sizes its partner may have.
    step = F.log(F.lit(1.02))
    border = rows.filter("miss <= 0").select("c", "x", "n", "both", "component", ((100 + percent) * F.col("both") < percent * (F.col("n") + F.col("n_c"))).alias("open"))
    border = border.withColumn("level", F.floor(F.log("n") / step).cast("int"))
    top = F.floor((100 + percent) * F.col("both") / F.lit(percent) - F.col("n") + 1e-9)
    low = F.greatest(F.lit(1), F.floor(percent * F.col("n") / F.lit(100)))
    levels = F.sequence(F.floor(F.log(low) / step).cast("int"), F.floor(F.log(top) / step).cast("int"))
    some = border.filter(F.col("open") & (top >= low)).select("c", F.col("x").alias("x_a"), F.col("n").alias("n_a"), F.col("both").alias("both_a"), F.col("component").alias("component_a"), F.explode(levels).alias("level"))
    others = border.select("c", "level", *[F.col(k).alias(f"{k}_b") for k in ("x", "n", "both", "component")])
    near = some.join(others, ["c", "level"]).filter(close).filter(f"{100 + percent} * least(both_a, both_b) >= {percent} * (n_a + n_b)")
    pairs = pairs.union(near.select(F.least("x_a", "x_b"), F.greatest("x_a", "x_b"))).distinct()
    return cut(pairs, "near-pairs"), cut(keys.filter(F.col("members") > short).select("c", "s", "x"), "near-long")


def by_centre(members: DataFrame, name: list[str]) -> DataFrame:
    """(c, x): the members of lists (named by columns ``name``, with their count ``members``), each with the list's centre, the member with the most company in all lists."""
    company = members.groupBy("x").agg(F.sum("members").alias("company"))
    centre = members.join(company, "x").groupBy(*name).agg(F.max_by("x", F.struct("company", "x")).alias("c"))
    centre = cut(centre, "near-centres")
    return members.join(centre, name).filter("x <> c").select("c", "x").distinct()


def links_between(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join every two linked classes that share a group, directly or through others."""
    links, short = None, SHORT
    while True:
        with_centre = shared(groups, sets if links is None else only(sets, groups, "c", "x"))
        near = with_centre.filter(f"{100 + percent} * both >= {percent} * (n + n_c)").select(F.col("c").alias("a"), F.col("x").alias("b"))
        links = near if links is None else links.union(near)
        pairs, long = candidates(with_centre, components(links), percent, short)
        release_shuffles(sets.sparkSession)
        links = links.union(confirm(pairs, sets, percent))
        if not long.take(1):
            return links
        sizes = cut(long.groupBy("c", "s").agg(F.count("*").alias("members")), "near-sizes")
        renamed = long.join(sizes, ["c", "s"]).select(F.col("c").alias("of"), "s", "x", "members")
        groups, short = cut(by_centre(renamed, ["of", "s"]), "near-groups"), 2 * short


def labelled(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, the component's key (null without one) and component_id."""
    spark = docs.sparkSession
    texts = docs_view(docs).select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    with batches_of(spark, 1_000):
        rows = cut(texts.mapInArrow(sketches(size), SKETCH), "near-rows")
    classes = rows.filter("doc_id is not null and n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("bands").alias("bands"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("key"), "set_key", "one.doc_id", "one.text_key", "bands"), "near-classes")
    members = classes.select(F.col("key").alias("x"), F.explode("bands").alias("band"))
    buckets = cut(members.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "near-buckets")
    members = cut(members.join(buckets, "band"), "near-members")
    release_shuffles(spark)
    involved = classes.join(members.select(F.col("x").alias("key")).distinct(), "key", "left_semi")
    sets = full_sets(texts, involved, size)
    groups = cut(by_centre(members, ["band"]), "near-groups")
    release_shuffles(spark)
    found = components(links_between(groups, sets, percent))
    found = classes.select("key", "set_key", "doc_id").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    found = cut(found.select("set_key", "component", "doc_id"), "near-found")
    names = cut(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-names")
    named = cut(found.join(names, "component").select("set_key", "component", "component_id"), "near-named")
    release_shuffles(spark)
    drop(members, buckets, sets, groups, found, names)
    alone = rows.filter("doc_id is null or n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    linked = rows.filter("doc_id is not null and n_shingles > 0").select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key")
    return linked.select("doc_id", "text_key", "n_shingles", "component", "component_id").union(alone)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: n_shingles, the component and whether the row's document stays."""
    return labelled(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, with its smallest doc_id; of rows without words one for each doc_id; all rows with a null doc_id."""
    one = labelled(docs, size, percent).filter("doc_id is not null").groupBy("component", F.when(F.col("component").isNull(), F.col("component_id")).alias("alone")).agg(F.min(F.struct("doc_id", "text_key")).alias("one"))
    chosen = cut(one.select(F.col("one.doc_id").alias("__weir_id"), F.col("one.text_key").alias("__weir_key")), "near-chosen")
    rows = docs.withColumn("__weir_text", F.xxhash64(F.col("text").cast("string")))
    kept = rows.join(chosen, (F.col("doc_id").cast("long") == F.col("__weir_id")) & (F.col("__weir_text") == F.col("__weir_key")), "left_semi").dropDuplicates(["doc_id", "__weir_text"])
    return kept.drop("__weir_text").unionByName(docs.filter(F.col("doc_id").isNull()))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=4)


QUERIES = {"op4_near_duplicates": op4_near_duplicates}
