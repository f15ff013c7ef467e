"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes all rows its predecessor kept. Only the first stage trains anything (on the rows of
``documents`` it gets, without the held-out ones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontam, langid, minhash, mixing, tokenout
from evidentia.llm.common import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and texts without a letter. Others stay, and their lang
    becomes the predicted one."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    told = langid.labelled(docs, model)
    return told.filter("lang <> 'und'").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity of 0.8 or more): the smallest
    doc_id. Repeated rows and those with a null doc_id are taken as ``minhash.deduplicated`` says."""
    return minhash.deduplicated(docs, width=5, percent=80)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; mostly contaminated documents go."""
    return decontam.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it."""
    return mixing.mixed(docs, weights=(5, 2, 1), share=1.5, most=2)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns, as read back, each document's place, length and checksum."""
    return tokenout.tokenized(docs)


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontam_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: No SQL: the model, the knapsack and the tokenizer have none. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].replace("/", "-"))
    return docs
