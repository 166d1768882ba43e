"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets and packing, over whole documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
checkpoint folder and rereads it as the next one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.llm.common import cut, table, written
from utterscope.llm.decontaminate import decontaminate
from utterscope.llm.packing import pack
from utterscope.llm.quality import keep_good
from utterscope.llm.secrets import redact
from utterscope.llm.simhash import deduplicate
from utterscope.llm.token_count import token_counts

#: Near-duplicates: shingles of five words, of a similarity of SIMILAR or more. Candidates have at most NEAR_BITS differing
#: bits in their fingerprints, or share a band of least hashes.
SHINGLE = 5
SIMILAR = 0.8
NEAR_BITS = 4


def counted(docs: DataFrame) -> DataFrame:
    """n_chars as the changed text has it; the order of columns stays."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id."""
    return deduplicate(docs, shingle=SHINGLE, distance=NEAR_BITS, similar=SIMILAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which they cover over half go."""
    return counted(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot, by its token count."""
    return pack(cut(token_counts(docs).select("doc_id", "n_tokens")), length="n_tokens")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("packing", packing),
]

#: The classifier and the fingerprints are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
