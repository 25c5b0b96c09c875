"""Token counts through a digest cache (op 2).

The cache is a table (digest, version, n_tokens) in the shared folder; it
stays there for later runs, which encode only texts that are new to it. The
query keeps one for each input folder, so the work of a run does not depend on
what was run on other inputs before. A text
is keyed by a digest of its normalised content and the tokenizer by a digest
of its file. Texts whose key the cache lacks are reduced to one row a digest
before the exchange, encoded once, and appended; the counts then come from the
cache alone.

The normalisation must not change the count: for a tokenizer that drops white
space, runs of ASCII white space become one space; for others nothing changes.
For the same reason such a tokenizer may count a text as the sum over its
space-separated parts, which a worker remembers.

Edge cases: a null text counts as an empty one (0 tokens, 0 bytes); repeated
rows each get a row; a null doc_id is kept; an empty table gives an empty
result; other columns are not read. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_view, read, shared_dir

CACHE = "digest binary, version string, n_tokens long"
#: Distinct parts a worker remembers before it starts anew.
PARTS = 1_000_000


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def drops_white_space(path: str) -> bool:
    """Whether the file's pre-tokenizer throws white space away, so that parts between spaces are counted alone."""
    if not path.endswith(".json"):
        return False
    spec = json.loads(Path(path).read_text())
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and r"[^\s" in pattern and r"\s+" not in pattern


def encoder(path: str):
    """texts -> token counts, by the library of the file."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def counting(path: str, by_part: bool):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, known = encoder(path), {"": 0}
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            if by_part:
                split = [t.split(" ") for t in texts]
                fresh = list(set().union(*split).difference(known)) if split else []
                if len(known) > PARTS:
                    known = {"": 0}
                    fresh = list(set().union(*split).difference(known))
                for k in range(0, len(fresh), 20_000):
                    known.update(zip(fresh[k : k + 20_000], encode(fresh[k : k + 20_000])))
                counts = [sum(map(known.__getitem__, parts)) for parts in split]
            else:
                counts = encode(texts)
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("version"), pa.array(np.array(counts, dtype=np.int64))], names=["digest", "version", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """Count tokens of every text. cache: the folder of the cache table, by default one in the shared folder; it is made where it is missing."""
    spark = docs.sparkSession
    version, by_part = tokenizer_version(tokenizer), drops_white_space(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    if by_part:
        text = F.regexp_replace(text, "[ \\n\\r\\t]+", " ")
    keyed = docs_view(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), text.alias("text"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("text", 256)))
    cache = cache or f"{shared_dir(spark)}/weir-cache/token-counts"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
    misses = keyed.join(known.select("digest"), "digest", "left_anti") if known.take(1) else keyed
    misses = misses.groupBy("digest").agg(F.first("text").alias("text")).withColumn("version", F.lit(version))
    misses.mapInArrow(counting(tokenizer, by_part), CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
    known = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # an append may have been repeated
    return keyed.select("doc_id", "n_bytes", "digest").join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def cache_of(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an input's own cache."""
    return f"{shared_dir(spark)}/weir-cache/token-counts-{hashlib.sha256(sf_dir.rstrip('/').encode()).hexdigest()[:32]}"


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache_of(spark, sf_dir))


QUERIES = {"op2_token_counts": op2_token_counts}
