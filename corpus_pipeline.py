"""A corpus pipeline of five stages: quality, near duplicates, benchmark passages, mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilmark.llm import decontam, mixing, quality, similar, tokenfile
from veilmark.llm.common import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more. Null and empty texts are scored as texts without words; repeated
    rows go or stay together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by SimHash fingerprints (op1's: 3-word shingles, at most two
    bits apart) or by 5-word shingles of Jaccard 0.8 or more. Texts without words, null ones among them, are one group; of
    repeated rows one stays."""
    return similar.keep_one(docs, simhash=3)


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly such passages go. Null and empty texts stay as they are."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's target weight asks for. A null source is one of its own; texts without words
    are taken where their source has words left to fill."""
    return mixing.repeated(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and one row a document with its place in them. Null and empty texts are the end id alone."""
    return tokenfile.tokenised(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup, and by shingle sets", no_near_copies),
    ("benchmark decontamination", no_benchmark_passages),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]

#: Shingle sets and tokenizers are beyond SQL. Tests hold the near-duplicate stage against brute force over all pairs and the
#: others against the operators they call, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
    return docs
