"""Cleaning pipeline over documents: language identification, near-dedup, decontamination, secret masking, tokens.

Every stage but the last returns the columns it was given. A row without doc_id passes the near-dedup, since its
removal could not be named; a doc_id that occurs in several rows is one document there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, decontaminate, langid, minhash, secrets
from strandlake.llm.common import checkpointed

#: Profile agreement below which a text is in none of the known languages.
LEAST_LANGUAGE_SCORE = 0.15
#: Words of a shingle for near-duplicates.
SHINGLE_WORDS = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; null, empty and letterless texts go. Repeated rows are judged alike."""
    profiles = langid.learn(docs.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    found = langid.predicted(profiles, F.col("text"), spark)
    return docs.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= LEAST_LANGUAGE_SCORE))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group. A row whose text or doc_id is null stays."""
    found = minhash.near_duplicates(docs, SHINGLE_WORDS)
    return docs.join(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Null and empty texts contain none; repeated rows are judged alike."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the text; n_chars follows it. A null text stays null; repeated rows are masked alike."""
    masked = docs.withColumn("text", secrets.redacted(secrets.learn(docs), F.col("text"), spark))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes; a null text is empty. A row for every row."""
    return bpe.round_trip(docs, bpe.public_codec())


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: SQL can't express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
