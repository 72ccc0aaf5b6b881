"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  Every
stage's rows are written as Parquet and read again, so a lost executor costs one stage's
tasks at most.  All but the last return the columns of ``documents``.

All stages alike: a null text counts as an empty one and stays null; empty texts and null doc_ids are kept; an empty table gives an
empty result; texts of any length are read whole; further columns go along, but through packing, which returns pieces.
Of rows equal in doc_id and text near-duplicates keeps one.  Which of equally long pieces takes which slot is open.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tindera.llm import decontaminate, minhash, packing, pii, toxicity
from tindera.llm.shared import bound_batches, free, settle, table, without

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; clean and unlabelled ones are scored alike."""
    bound_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates its smallest doc_id stays, and one of equal rows."""
    return minhash.drop_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with five per cent of their words in benchmark windows go; a row without words stays, equal rows go or stay together."""
    key = free("__key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = decontaminate.contamination(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = settle(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return without(keyed, bad, key).select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their ids, each with its sequence and its place there."""
    pieces = packing.tokenize_pieces(docs, public_tokenizers.path(TOKENIZER), payload="packed_ids", numbered=True)
    return packing.pack(pieces, open_as="ids", numbered=("task", "place"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = settle(docs, f"stage-{name}")
    return docs


#: The classifier and the tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None
