"""A corpus pipeline: quality, near duplicates, personal data, mixing and packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of documents; the last gives sequences.
Rows with a null id can't be told apart by id; they pass the stages that decide by it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import minhash, mixing, packing, pii, quality
from mapweave.runtime import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Clean tokens stay as many as they are; toxic ones are brought down to this part of the mix.
MIX = {"clean": 0.98, "toxic": 0.02}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from this stage's own input.

    Rows are judged by their text alone: repeated rows, rows with a null id and null or empty texts like any other.
    """
    own = docs.select(*COLUMNS)
    return quality.accepted(own, quality.train(own, _labels(spark, sf_dir)))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Rows that repeat an id are one document, of which one row stays: the one with the smallest hash of its columns. Texts without words are
    near nothing and stay. Rows with a null id stay.
    """
    own = docs.select(*COLUMNS)
    gone = materialize(minhash.near_duplicates(own, shingle_words=5, percent=80).filter("not kept").select("doc_id").distinct(), "gone")
    row = F.xxhash64(*COLUMNS)
    again = own.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows"), F.min(row).alias("__row")).filter("__rows > 1")
    again = materialize(again.join(gone, "doc_id", "left_anti"), "again")
    once = own.join(gone.unionByName(again.select("doc_id")), "doc_id", "left_anti")
    return once.unionByName(own.join(again, "doc_id").filter(row == F.col("__row")).select(*COLUMNS).dropDuplicates(["doc_id"]))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows. Every row stays; a null text stays null, with null n_chars."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: clean ones stay about once, toxic ones mostly go.

    Rows that repeat an id share its rate; rows with a null id stay once. Null and empty texts have no tokens, and the rate of a text
    that tells nothing.
    """
    domain = F.when(F.col("domain") == "toxic", "toxic").otherwise("clean")
    marks = mixing.marks(_labels(spark, sf_dir)).select("doc_id", domain.alias("domain"))
    return mixing.sampled(docs, marks, MIX, anchor="clean", columns=COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens. A null or empty text is its end mark alone; every row is packed, with a null id or a repeated one too."""
    return packing.best_fit(docs, **packing.byte_level(public_tokenizers), capacity=2048)


STAGES = [
    ("quality", quality_stage),
    ("minhash", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training, hashing and packing have no SQL form; tests/llm holds the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
