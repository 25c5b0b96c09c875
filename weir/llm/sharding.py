"""Sharding by balanced label propagation, with DataFrame operations only (op 3).

Documents that share a link (for the query: equal texts) are neighbours. All
start in a shard by hash. In each round a document looks at the shards its
neighbours lie in, wants the one with most of them that has room, and moves if
that is better than where it is and the shard's quota allows; quotas keep
linked documents within an even share. At last documents without neighbours
(then others, if there is no way round it) leave the shards that hold too many
and fill those that hold too few, so that the law ``rows`` holds exactly:
counts differ by one at most.

Neighbourhoods go through counts for (link, shard), never through pairs; ranks
are counted within hash buckets and shifted by the buckets' sizes, so neither
a large group nor a shard has to fit into one task. What reaches the driver
are counts for each shard.

Edge cases: a null text has no bytes and counts as an empty one; all rows get
a place, also null and repeated doc_ids; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, docs_view, drop, read

#: Hash buckets in which ranks are counted.
BUCKETS = 1024


def gapless(df: DataFrame, part: str, bucket: Column, order: list, name: str) -> DataFrame:
    """Ranks 0, 1, ... for each ``part``, ordered by (bucket, order)."""
    df = df.withColumn("__b", bucket)
    sizes = df.groupBy(part, "__b").count()
    before = F.sum("count").over(Window.partitionBy(part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(part).alias("__p"), F.col("__b").alias("__c"), F.coalesce(before, F.lit(0)).alias("__before"))
    # One row for each shard and bucket: at most shards x 2 BUCKETS rows.
    df = df.join(F.broadcast(sizes), (F.col(part) == F.col("__p")) & (F.col("__b") == F.col("__c")))
    rank = F.row_number().over(Window.partitionBy(part, "__b").orderBy(*order)) - 1
    return df.withColumn(name, F.col("__before") + rank).drop("__b", "__p", "__c", "__before")


def hash_bucket(*cols, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(11)), F.lit(n)).cast("int")


def by_shard(values: list, shard: Column) -> Column:
    """The shard's value, from a list for all shards."""
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), shard)


def propagate(members: DataFrame, labels: DataFrame, n_shards: int, quota: int, rounds: int) -> DataFrame:
    """Move linked nodes. members: (uid, link); labels: (uid, shard) of exactly those nodes."""
    for _ in range(rounds):
        load = {r[0]: r[1] for r in labels.groupBy("shard").count().collect()}
        free = [max(0, quota - load.get(s, 0)) for s in range(n_shards)]
        # Written, so that the joins below deal plain rows and Spark can split a large link's.
        near = cut(members.join(labels, "uid").groupBy("link", "shard").agg(F.count("*").alias("n")), "shard-near")
        # At most one row for each shard in a link's window: the fullest with room, and all for the present place.
        best = F.row_number().over(Window.partitionBy("link").orderBy(F.desc("n"), F.pmod(F.col("shard") + F.hash("link"), F.lit(n_shards))))
        room = near.filter(by_shard(free, F.col("shard")) > 0).withColumn("r", best).filter("r <= 3").select("link", F.col("shard").alias("to"), "n")
        room = cut(room, "shard-room")
        want = members.join(room, "link").groupBy("uid", "to").agg(F.sum("n").alias("n"))
        want = want.groupBy("uid").agg(F.max(F.struct("n", F.negative("to").alias("k"))).alias("w")).select("uid", (-F.col("w.k")).alias("to"), F.col("w.n").alias("gain"))
        here = members.join(labels, "uid").join(near, ["link", "shard"]).groupBy("uid", "shard").agg(F.sum("n").alias("n"), F.min("link").alias("link"))
        moves = here.join(want, "uid").filter((F.col("to") != F.col("shard")) & ((F.col("gain") > F.col("n")) | ((F.col("gain") == F.col("n")) & (F.col("to") < F.col("shard")))))
        moves = gapless(moves.select("uid", "to", "link"), "to", hash_bucket("link", n=BUCKETS // 32) * 32 + hash_bucket("uid", n=32), ["link", "uid"], "place")
        moves = cut(moves.filter(F.col("place") < by_shard(free, F.col("to"))).select("uid", "to"), "shard-moves")
        if not moves.take(1):
            break
        labels = cut(labels.join(moves, "uid", "left").select("uid", F.coalesce("to", "shard").alias("shard")), "shard-labels")
    return labels


def shard_rows(nodes: DataFrame, members: DataFrame, n_shards: int, rounds: int) -> DataFrame:
    """(uid, shard) of all nodes, counts at most one apart. nodes: (uid); members: (uid, link) of linked nodes."""
    total = nodes.count()
    start = nodes.select("uid", F.pmod(F.xxhash64("uid"), F.lit(n_shards)).cast("int").alias("shard"))
    linked = members.select("uid").distinct()
    moved = propagate(members, cut(start.join(linked, "uid", "left_semi"), "shard-labels"), n_shards, total // n_shards, rounds)
    labels = start.join(moved.select("uid", F.col("shard").alias("moved")), "uid", "left")
    labels = cut(labels.select("uid", F.coalesce("moved", "shard").alias("shard"), F.col("moved").isNotNull().cast("int").alias("linked")), "shard-labels")
    load = {r[0]: r[1] for r in labels.groupBy("shard").count().collect()}
    target = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    over = [max(0, load.get(s, 0) - target[s]) for s in range(n_shards)]
    under = [max(0, target[s] - load.get(s, 0)) for s in range(n_shards)]
    ranked = gapless(labels, "shard", F.col("linked") * BUCKETS + hash_bucket("uid"), ["uid"], "place")
    place = F.col("place") + by_shard([sum(over[:s]) for s in range(n_shards)], F.col("shard"))
    to = F.lit(n_shards - 1)
    for s in reversed(range(n_shards)):
        to = F.when(place < sum(under[: s + 1]), s).otherwise(to)
    leaves = F.col("place") < by_shard(over, F.col("shard"))
    return cut(ranked.select("uid", F.when(leaves, to).otherwise(F.col("shard")).cast("int").alias("shard")), "shard-labels")


def shard_documents(docs: DataFrame, n_shards: int = 24, rounds: int = 6) -> DataFrame:
    """Per row: size, text_crc32, law, shard, slot and grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs_view(docs).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("link"))
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()), "shard-rows")
    shared = rows.groupBy("link").count().filter("count > 1").select("link")
    members = cut(rows.join(shared, "link").select("uid", F.xxhash64("link").alias("link")), "shard-members")
    labels = shard_rows(rows.select("uid"), members, n_shards, rounds)
    placed = gapless(labels, "shard", hash_bucket("uid"), ["uid"], "slot")
    drop(members)
    return rows.join(placed, "uid").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op3_sharding": op3_sharding}
