"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, licenses, mixing, oracles, quality, simhash, spelling, substring, tandem, tokencount, tokenfile, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return decontam.digest(found)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.without_repeats(_table(spark, sf_dir, "documents")))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.tokenised(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, the end of which repeats in one of ten documents, chosen by a hash of their ids."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tandem.periodic_runs(_table(spark, sf_dir, "documents"), edit=_planted)
    ratio = lambda r: F.struct((r["length"] / r["period"]).alias("ratio"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", F.array_max(F.transform("runs", ratio))).withColumns({"start": -F.col("best.start"), "length": F.col("best.length"), "period": -F.col("best.period")})
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("(1000 * length) div period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def _misspelt(doc_id: int | None) -> Callable[[str], str]:
    """For a document the runs of letters, one of 97 of them without a letter, by a hash of both."""
    if doc_id is None:
        return lambda run: run
    start = zlib.crc32(f"{doc_id}:".encode())

    def word(run: str) -> str:
        h = zlib.crc32(run.encode(), start)
        return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]

    return word


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), edit=_misspelt)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": simhash_dedup,
    "op2_source_mix": source_mix,
    "op3_quality_scores": quality_scores,
    "op4_license_scan": license_scan,
    "op5_nearest_vectors": nearest_vectors,
    "op6_url_filter": url_filter,
    "op7_decontamination": decontamination,
    "op8_substring_dedup": substring_dedup,
    "op9_token_files": token_files,
    "op10_token_counts": token_counts,
    "op11_periodic_runs": periodic_runs,
    "op12_bpe_round_trip": bpe_round_trip,
    "op13_spelling_variants": spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": oracles.source_mix(),
    "op4_license_scan": oracles.license_scan(),
    "op6_url_filter": oracles.url_filter(),
    "op7_decontamination": oracles.decontamination(),
    "op8_substring_dedup": oracles.substring_dedup(),
}
