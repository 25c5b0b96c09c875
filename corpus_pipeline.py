"""A training-corpus pipeline: five stages over ``documents``, each one an operator of ``weir.llm``.

Every stage gets the documents its predecessor kept and returns documents
again, but for the last, which returns token ids, decoded once to check them. Between stages the rows are
written and read again, so a stage can be repeated alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import decontaminate, near_duplicates, piece_lattice, substrings, toxicity
from weir.llm.common import cut, drop, read, scratch

MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below one half; the model is fitted to ``labels`` on the documents themselves."""
    score = toxicity.scorer(toxicity.train(docs, read(spark, sf_dir, "labels")), spark)
    return docs.filter(score("text") < 0.5)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    return near_duplicates.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 50 words that an earlier document holds; ``n_chars`` follows."""
    out = substrings.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of ``benchmark``. Each row is judged by its own text, named by a 64-bit hash, so null and repeated doc_ids do not matter."""
    name = F.xxhash64(F.col("text").cast("string"))
    found = decontaminate.contamination(docs.select(name.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("__weir_text")).distinct()
    return docs.join(bad, name == bad["__weir_text"], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives its text back."""
    return piece_lattice.encode_and_decode(docs, public_tokenizers.path(MODEL)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_near_duplicate),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The stages' models, sketches and merges are beyond SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote on the way is deleted."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch():
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", stays=True)
        drop(*before)
        before = [docs]
    return docs
