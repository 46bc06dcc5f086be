"""Readers and writers of annotated sets, configurations, response logs and result files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Annotated queries from text in blocks: ===QUERY===, text, ===PHI_TAGS===, one JSON object a line.

    Blank blocks are dropped before blocks are numbered (Q-0001 on); blocks without the second delimiter
    keep their number and give no query. Lines that are no object of type and value are skipped.
    """
    whole = spark.read.text(path, wholetext=True)
    blocks = F.filter(F.split("value", "===QUERY==="), lambda b: strip(b) != "")
    rows = whole.select(F.posexplode(blocks).alias("n", "block")).filter(F.contains("block", F.lit("===PHI_TAGS===")))
    parts = F.split("block", "===PHI_TAGS===", 2)
    lines = F.filter(F.transform(F.split(parts[1], r"\R"), strip), lambda x: x != "")
    objects = F.transform(lines, lambda x: F.from_json(x, "identifier_type string, value string"))
    return rows.select(
        F.format_string("Q-%04d", F.col("n") + 1).alias("query_id"), strip(parts[0]).alias("query_text"),
        F.filter(objects, lambda o: o["identifier_type"].isNotNull() & o["value"].isNotNull()).cast(schemas.PHI).alias("phi_tags"),
    ).select("query_id", "query_text", "phi_tags", F.size("phi_tags").alias("phi_count"), (F.size("phi_tags") == 0).alias("is_negative"))


def metadata(gold: DataFrame, dataset: str = "annotated queries", version: str = "1.0", source_file: str = "") -> DataFrame:
    """The one row that describes a gold set: counts of queries and values, types and values a query."""
    types = type_distribution(gold).agg(F.map_from_entries(F.collect_list(F.struct("identifier_type", "n"))).alias("phi_type_distribution"))
    sizes = complexity_histogram(gold).agg(F.map_from_entries(F.collect_list(F.struct(F.col("phi_count").cast("string"), "n"))).alias("query_complexity_distribution"))
    totals = gold.agg(
        F.count("*").alias("total_queries"), F.count_if(~F.col("is_negative")).alias("positive_queries"), F.count_if("is_negative").alias("negative_queries"),
        F.coalesce(F.sum("phi_count"), F.lit(0)).cast("long").alias("total_phi_elements"),
    )
    names = [F.lit(v).alias(k) for k, v in (("dataset", dataset), ("version", version), ("source_file", source_file))]
    return totals.crossJoin(types).crossJoin(sizes).select(*names, "*")  # three frames of one row


def type_distribution(gold: DataFrame) -> DataFrame:
    """(identifier_type, n), the most frequent first, ties by the first query that has the type."""
    each = gold.select("query_id", F.posexplode("phi_tags").alias("at", "p"))
    rows = each.groupBy(F.col("p.identifier_type").alias("identifier_type")).agg(F.count("*").alias("n"), F.min(F.struct("query_id", "at")).alias("first"))
    return rows.orderBy(F.desc("n"), "first").drop("first")


def complexity_histogram(gold: DataFrame) -> DataFrame:
    """(phi_count, n), fewest first."""
    return gold.groupBy("phi_count").agg(F.count("*").alias("n")).orderBy("phi_count")


def check_counts(gold: DataFrame, positive: int, negative: int, values: int) -> list[str]:
    """Differences from the expected counts, as warnings."""
    found = metadata(gold).first()
    pairs = (("positive queries", found["positive_queries"], positive), ("negative queries", found["negative_queries"], negative), ("annotated values", found["total_phi_elements"], values))
    return [f"expected {want} {name}, found {have}" for name, have, want in pairs if have != want]


def write_dataset(gold: DataFrame, path: str, **about) -> None:
    """The gold set as one JSON document with its metadata. A single document is one task's work; sets
    that are not small go to ``write_queries``."""
    queries = gold.agg(F.array_sort(F.collect_list(F.struct("query_id", "query_text", "phi_tags", "phi_count", "is_negative"))).alias("queries"))
    described = metadata(gold, **about).select(F.struct("*").alias("metadata"))
    described.crossJoin(queries).select(F.to_json(F.struct("metadata", "queries")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_queries(gold: DataFrame, path: str, **about) -> None:
    """The gold set of any size: ``path``/queries as JSON lines in as many files as it has partitions, and its one row of
    metadata as ``path``/metadata."""
    gold.select("query_id", "query_text", "phi_tags", "phi_count", "is_negative").write.mode("overwrite").json(f"{path}/queries")
    metadata(gold, **about).write.mode("overwrite").json(f"{path}/metadata")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Annotated queries from JSON documents of metadata and queries."""
    return spark.read.schema(schemas.ENVELOPE).json(path, multiLine=True).select(F.inline("queries"))


def read_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Annotated queries and metadata as ``write_queries`` writes them."""
    return spark.read.schema(schemas.QUERY).json(f"{path}/queries"), spark.read.schema(schemas.METADATA).json(f"{path}/metadata")


def read_config(spark: SparkSession, path: str) -> dict:
    """A small JSON configuration (prompts, models or parameters), read by way of Spark."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def prompts(spark: SparkSession, templates: dict) -> DataFrame:
    """One row for each prompt: slug, system prompt, templates, parser. Keys that start with _ are notes."""
    fields = ("slug", "name", "system_prompt", "user_template", "pass1_user_template", "pass2_system_prompt", "pass2_user_template", "output_parser", "content_hash")
    rows = [tuple(v.get(f) for f in fields) for k, v in templates.items() if not k.startswith("_")]
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))


def by_slug(entries: list[dict], slug: str) -> dict:
    """The entry with a slug; an unknown one is an error."""
    for e in entries:
        if e.get("slug") == slug:
            return e
    raise ValueError(f"{slug} is not configured")


def parameters(base: dict, model: dict | None = None, prompt: dict | None = None) -> dict:
    """Base parameters under those of the model under those of the prompt; notes are no parameters."""
    return {**base, **{k: v for k, v in (model or {}).items() if k != "notes"}, **(prompt or {})}


def run_of(path: Column) -> tuple[Column, Column, Column]:
    """model, prompt and run of a path like .../{model}/{prompt}/run_{n}/responses.jsonl."""
    rx = r"/([^/]+)/([^/]+)/run_(\d+)/[^/]*$"
    return F.regexp_extract(path, rx, 1), F.regexp_extract(path, rx, 2), F.regexp_extract(path, rx, 3).cast("int")


def _with_path(rows: DataFrame) -> DataFrame:
    """model, prompt and run from .../{model}/{prompt}/run_{n}/responses.jsonl, and seq within the file.

    seq orders the records of a file: Spark splits JSON-lines files in order, so the block's start and the place in the
    block, added up, rise along it. In a file of one block it is the record's number.
    """
    order = Window.partitionBy("_file", "_block").orderBy("_id")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # the block's start is the place of its first byte, and no block has more records than bytes: places rise from block to block
    placed = rows.withColumn("seq", (F.col("_block") + F.row_number().over(order)).cast("long"))
    return placed.withColumns(dict(zip(("model", "prompt", "run"), run_of(F.col("_file"))))).drop("_file", "_block", "_id")


def read_responses(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Response logs (a path, folder or glob of JSON lines). Broken lines are dropped, or with ``strict``
    an error. Logs laid out as model/prompt/run_n give those columns and ``seq``."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return _with_path(spark.read.schema(schemas.RESPONSE).option("mode", mode).json(path))


def append_responses(responses: DataFrame, path: str) -> None:
    """Append to a log of JSON lines partitioned by model, prompt and run, with its ``seq``."""
    responses.write.mode("append").partitionBy("model", "prompt", "run").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log as ``append_responses`` writes it; filters on model, prompt and run read only those folders."""
    return spark.read.schema(f"{schemas.RESPONSE}, seq bigint, model string, prompt string, run int").json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores by configuration. A new version of one's own input goes to another path, never over it."""
    scores.write.mode("overwrite").partitionBy("model", "prompt").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(table: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A published result list (one JSON array of configurations) in the columns of an evaluation."""
    schema = (
        "model string, model_label string, strategy string, strategy_label string, runs int, tier1_recall_mean double, tier1_recall_std double, "
        "tier1_recall_per_run array<double>, tier2_recall_mean double, tier2_recall_std double, tier2_precision_mean double, tier2_precision_std double, "
        "tier3_similarity_mean double, tier3_similarity_std double, tier3_pass_rate_mean double, specificity_mean double, specificity_std double, over_redaction double, "
        "errors struct<total_failures: bigint, timeout: bigint, parse_error: bigint, other: bigint>, "
        "latency struct<mean_ms: double, median_ms: double, p95_ms: double, p99_ms: double>, "
        "fp_taxonomy struct<type_a: bigint, type_b: bigint, type_c: bigint, type_d: bigint>"
    )
    rows = spark.read.schema(schema).json(path, multiLine=True)
    names = {"strategy": "prompt", "tier1_recall_mean": "t1_recall_mean", "tier1_recall_std": "t1_recall_std", "tier2_recall_mean": "t2_recall_mean", "tier2_recall_std": "t2_recall_std", "tier3_similarity_mean": "t3_similarity_mean", "tier3_pass_rate_mean": "t3_pass_mean", "runs": "runs_completed"}
    flat = {"errors_total": F.col("errors.total_failures")} | {f"latency_{x}_ms": F.col(f"latency.{x}_ms") for x in ("mean", "median", "p95", "p99")}
    return rows.withColumns(flat).withColumnsRenamed(names)


def same_hash(prompts_: DataFrame) -> Column:
    """Whether a prompt's stored hash is that of its texts."""
    from ..functions.text import prompt_hash

    return prompt_hash(F.col("system_prompt"), F.coalesce("user_template", "pass1_user_template")) == F.col("content_hash")
