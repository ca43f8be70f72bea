"""The queries opN_<name>: each operator over its whole table, with the columns that its contract fixes."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mapweave.llm import balls, embedding, infill, licences, minhash, mixing, packing, pii, quality, simhash, substring, toxicity, warc
from mapweave.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, links from 80 in 100 on."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, whatever their labels, from a cosine of 0.95 on."""
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels.quality marks the trusted positives; rows whose crc32 modulo 3 is 1 are held out."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words."""
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=13)


#: Parts of all tokens that the mix is to have.
MIX = {"clean": 0.90, "junk": 0.08, "toxic": 0.02}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains come from the labels table; the total number of tokens stays."""
    return mixing.mix(_table(spark, sf_dir, "documents"), mixing.marks(_table(spark, sf_dir, "labels")), MIX, keep=("source",))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice coefficients from 0.8 on."""
    return licences.scan(_table(spark, sf_dir, "documents"), least=0.8)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 bits, radius 3; the ids divisible by 20 are searched among all."""
    return simhash.digest(_table(spark, sf_dir, "documents"), radius=3, every=20)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; equal payloads of any size become revisits."""
    return warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; the other capacities are as large as that implies."""
    return packing.best_fit(_table(spark, sf_dir, "documents"), **packing.byte_level(public_tokenizers), capacity=2048)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels.toxic marks the documents; rows whose crc32 modulo 3 is 1 are held out; 1 is predicted from 0.7 on."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units are code points; 90 in 100 documents are rearranged, 20 in 100 of these with the suffix first."""
    made = infill.transform(_table(spark, sf_dir, "documents"), unit=infill.CODE_POINT, seed=1, rate=90, spm=20)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of vectors of 64 components, three rounds."""
    return balls.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_embedding": op2_embedding,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_licences": op5_licences,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_substring": op10_substring,
    "op11_toxicity": op11_toxicity,
    "op12_infill": op12_infill,
    "op13_balls": op13_balls,
}
