"""Annotated queries and responses made from plain tables, so that any engine can make the same.

Positives come from customers, their nation and their first order; negatives from parts. Responses are
fixed transformations of the queries by 3 models x 2 prompts x 3 runs, chosen by arithmetic on the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

MODELS, PROMPTS, RUNS = ("alpha", "beta", "gamma"), ("few-shot", "zero-shot"), 3
BRANCHES = 13
#: Identifiers in running text, for the lines of documents: (type, pattern).
NATURAL = (
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._]+@[a-z0-9.]+[a-z]"),
    ("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("PHONE_NUMBER", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("ACCOUNT_NUMBER", r"[0-9]{16}"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _value(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("identifier_type"), value.alias("value"))


def _of_kind(kind: str):
    return lambda value: _value(kind, value)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated queries (schemas.QUERY) and their integer ``key``."""
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "o_orderdate")).alias("o"))
    people = _table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    day, number = F.date_format("o.o_orderdate", "yyyy-MM-dd"), F.col("o.o_orderkey").cast("string")
    text = F.concat(F.lit("Patient "), "c_name", F.lit(" from "), "n_name", F.lit(" was seen on "), day, F.lit(" for diabetes follow up, MRN "), number, F.lit("."))
    positive = people.select(
        F.col("c_custkey").alias("key"), F.concat(F.lit("P-"), F.col("c_custkey").cast("string")).alias("query_id"), text.alias("query_text"),
        F.array(_value("NAME", F.col("c_name")), _value("GEOGRAPHIC_LOCATION", F.col("n_name")), _value("DATE", day), _value("MEDICAL_RECORD_NUMBER", number)).alias("phi_tags"),
    )
    negative = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.concat(F.lit("N-"), F.col("p_partkey").cast("string")).alias("query_id"),
        F.concat(F.lit("What is the usual dose of "), "p_name", F.lit(" for an adult with asthma, and should it be taken with food?")).alias("query_text"),
        F.array().cast(schemas.PHI).alias("phi_tags"),
    )
    both = positive.unionByName(negative)
    return both.select("query_id", "query_text", "phi_tags", F.size("phi_tags").alias("phi_count"), (F.size("phi_tags") == 0).alias("is_negative"), "key")


def natural_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nonempty line of the documents, with the identifiers that patterns find in it."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "query_text")).filter("query_text <> ''")
    found = F.concat(*[F.transform(F.regexp_extract_all("query_text", F.lit(rx), 0), _of_kind(k)) for k, rx in NATURAL])
    return lines.select(
        F.concat_ws("-", F.lit("D"), "doc_id", "line").alias("query_id"), "query_text", found.cast(schemas.PHI).alias("phi_tags"), F.col("doc_id").alias("key")
    ).select("query_id", "query_text", "phi_tags", F.size("phi_tags").alias("phi_count"), (F.size("phi_tags") == 0).alias("is_negative"), "key")


def _tags(form: str) -> Column:
    """The query with each of its values replaced by a tag of one form: exact, wrong, gone, generic or mixed."""
    spelled = {
        "exact": {"NAME": "[NAME]", "GEOGRAPHIC_LOCATION": "[LOCATION]", "DATE": "[DATE]", "MEDICAL_RECORD_NUMBER": "[MRN]"},
        "wrong": {"NAME": "[EMAIL]", "GEOGRAPHIC_LOCATION": "[DATE]", "DATE": "[PHONE]", "MEDICAL_RECORD_NUMBER": "[NAME]"},
        "gone": {"NAME": "", "GEOGRAPHIC_LOCATION": "", "DATE": "", "MEDICAL_RECORD_NUMBER": ""},
        "generic": {"NAME": "[REDACTED]", "GEOGRAPHIC_LOCATION": "[REDACTED]", "DATE": "[REDACTED]", "MEDICAL_RECORD_NUMBER": "[REDACTED]"},
        "mixed": {"NAME": "<PATIENT>", "GEOGRAPHIC_LOCATION": "[[CITY]]", "DATE": "***", "MEDICAL_RECORD_NUMBER": "{ID}"},
    }[form]
    text = F.col("query_text")
    table = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    return F.aggregate("phi_tags", text, lambda acc, p: F.replace(acc, p["value"], F.try_element_at(table, p["identifier_type"])))


def responses(gold_: DataFrame) -> DataFrame:
    """Response records (schemas.RESPONSE with model, prompt, run and seq) of all configurations."""
    spark = gold_.sparkSession
    rows = [(m, p, r, i * 5 + j * 2 + r * 3) for i, m in enumerate(MODELS) for j, p in enumerate(PROMPTS) for r in range(1, RUNS + 1)]
    configurations = spark.createDataFrame(rows, "model string, prompt string, run int, shift int")  # 18 rows
    branch = F.pmod(F.col("key") * 7 + F.col("shift"), F.lit(BRANCHES)).cast("int").alias("branch")
    each = gold_.crossJoin(F.broadcast(configurations)).select("*", branch)
    b = F.col("branch")
    negative = (
        F.when(b == 3, F.replace("query_text", F.lit("asthma"), F.lit("[NAME]"))).when(b == 4, F.concat("query_text", F.lit(" For example, such as [NAME] and other values that a text of this kind may hold.")))
        .when(b == 5, F.concat("query_text", F.lit(" Note that all of the identifiers in this text were replaced with [ID] or ***."))).when(b == 6, F.concat(F.lit("[REDACTED] "), "query_text"))
        .when(b == 7, F.lit("")).otherwise(F.col("query_text"))
    )
    positive = (
        F.when(b == 1, _tags("wrong")).when(b == 2, _tags("gone")).when(b == 3, F.col("query_text")).when(b == 4, F.concat(_tags("exact"), F.lit(" All identifiers were replaced, such as Jane Roe, 555-123-4567.")))
        .when(b == 5, _tags("generic")).when(b == 6, _tags("mixed")).when(b == 7, F.lit("")).otherwise(_tags("exact"))
    )
    output = F.when(b.isin(8, 9, 10), None).when(F.col("is_negative"), negative).otherwise(positive)
    error = F.when(b == 8, "timeout_120s").when(b == 9, "json_parse_failure").when(b == 10, "connection_error: refused")
    latency = F.when(b.isin(9, 10), -1).otherwise(F.pmod(F.col("key") * 37 + F.col("shift") * 11, F.lit(900)) + 100)
    null = lambda kind: F.lit(None).cast(kind)
    return each.select(
        "model", "prompt", "run", (F.col("key") * 2 + F.col("is_negative").cast("int")).alias("seq"), "query_id", F.col("model").alias("model_name"), F.lit("1").alias("model_version"), F.col("prompt").alias("prompt_style"),
        F.col("run").alias("run_number"), F.concat(F.lit("[USER] "), "query_text").alias("input_text"), F.lit("2024-01-01T00:00:00Z").alias("timestamp_utc"), output.alias("raw_output"), null("string").alias("extracted_output"),
        null("string").alias("parse_status"), error.alias("error"), latency.cast("bigint").alias("latency_ms"), F.lit(10).cast("bigint").alias("tokens_input"), F.length("query_text").cast("bigint").alias("tokens_output"), F.lit(False).alias("output_truncated"),
        null("string").alias("pass1_output"), null("bigint").alias("pass1_latency_ms"), null("string").alias("pass2_output"), null("bigint").alias("pass2_latency_ms"), null("string").alias("pass2_method"), F.lit(False).alias("is_canary"), null("int").alias("canary_position"),
    )


def log_with_repeats(responses_: DataFrame) -> DataFrame:
    """A log in which one query in eleven has a second, later record with another output, and each log a canary at both ends."""
    again = responses_.filter(F.col("seq") % 11 == 0).withColumns({"seq": F.col("seq") + 1_000_000_000, "raw_output": F.concat(F.coalesce("raw_output", F.lit("")), F.lit(" again")), "error": F.lit(None).cast("string")})
    logs = responses_.select("model", "prompt", "run").distinct()
    ends = logs.select("*", F.explode(F.array(F.lit(0), F.lit(1052))).alias("canary_position")).withColumns(
        {
            "query_id": F.when(F.col("canary_position") == 0, "canary_start").otherwise("canary_end"), "is_canary": F.lit(True),
            "seq": F.when(F.col("canary_position") == 0, -1).otherwise(2_000_000_000).cast("long"),
            "raw_output": F.when((F.col("canary_position") == 0) | (F.col("run") < 3), "same").otherwise("changed"),
        }
    )
    return responses_.unionByName(again).unionByName(ends, allowMissingColumns=True)


def item_answers(gold_: DataFrame) -> DataFrame:
    """Two-pass records whose item lists come in all forms that models write, readable or not."""
    items = F.transform("phi_tags", lambda p: F.to_json(F.struct(p["value"].alias("text"), p["identifier_type"].alias("type"))))
    form = F.pmod("key", F.lit(8))
    lines = F.array_join(items, "\n")
    answer = (
        F.when(form == 0, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).when(form == 1, lines).when(form == 2, F.concat(F.lit("```json\n["), F.array_join(items, ", "), F.lit("]\n```")))
        .when(form == 3, F.array_join(items, ", ")).when(form == 4, F.concat(F.lit("Found: "), lines, F.lit(" - done"))).when(form == 5, F.lit("No PHI found")).when(form == 6, F.lit("sorry")).otherwise(F.lit(None))
    )
    rows = responses(gold_).filter("model = 'alpha' and prompt = 'zero-shot' and run = 1").drop("pass1_output", "error", "raw_output")
    return rows.join(gold_.select("query_id", answer.alias("pass1_output")), "query_id").withColumns({"error": F.lit("json_parse_failure"), "raw_output": F.lit(None).cast("string")})


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, query, output): each user turn and the assistant's next one."""
    rows = _table(spark, sf_dir, "conversations")
    asked = rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    said = rows.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return asked.join(said, ["conv_id", "turn"])
