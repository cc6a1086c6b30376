"""The corpus pipeline: documents become clean, deduplicated, mixed and tokenised training data in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalstudy.llm import exact, minhash, mixing, spm, toxicity
from signalstudy.llm.common import cut, table
from signalstudy.llm.queries import piece_model, toxicity_model


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.7 or more go."""
    return toxicity.keep_clean(docs, toxicity_model(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest doc_id stays."""
    return exact.exact_dedup(docs)


def novel(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, the smallest doc_id stays."""
    return minhash.near_dedup(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each time the mix takes it, in training order."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids, n_tokens, and whether the ids decode to the text."""
    model = piece_model()
    out = spm.encode(docs.select("doc_id", "source", "text"), model, check_col="round_trip")
    return out.select("doc_id", "source", "token_ids", F.size("token_ids").alias("n_tokens"), "round_trip")


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("minhash_near_dedup", novel), ("mixing", mixed), ("sentencepiece", tokens)]

#: The fitted toxicity model can't be written in SQL; the tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
