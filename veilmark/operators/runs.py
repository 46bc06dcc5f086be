"""Response logs: last record wins, resume, canaries, repair of two-pass records, determinism pilot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonitems import json_items
from ..functions.text import levenshtein_similarity, redact
from .evaluate import without_canaries

LOG = ["model", "prompt", "run"]


def last_records(responses: DataFrame, by: list[str] = LOG) -> DataFrame:
    """The last record of each query of a log, at the place (``position``) of its first.

    ``seq`` orders the records of a log; it is given when a log is read, for Spark keeps no file order.
    """
    first = responses.groupBy(*by, "query_id").agg(F.max("seq").alias("seq"), F.min("seq").alias("position"))
    return responses.join(first, [*by, "query_id", "seq"])


def duplicates_removed(responses: DataFrame, by: list[str] = LOG) -> DataFrame:
    return responses.groupBy(*by).agg((F.count("*") - F.count_distinct("query_id")).alias("duplicates_removed"))


def todo(gold: DataFrame, responses: DataFrame, configurations: DataFrame, retry_errors: bool = False) -> DataFrame:
    """(model, prompt, run, query_id) still without a record. Failed queries count as done unless ``retry_errors``."""
    done = responses.filter(F.coalesce("error", F.lit("")) == "") if retry_errors else responses
    wanted = gold.select("query_id").crossJoin(F.broadcast(configurations.select(*LOG)))  # a row for each configuration and run
    return wanted.join(done.select(*LOG, "query_id"), [*LOG, "query_id"], "left_anti")


def configurations(models: DataFrame, prompts: DataFrame, runs: int = 3) -> DataFrame:
    """Every model with every prompt and run."""
    n = models.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run"))
    return models.crossJoin(prompts).crossJoin(n)


def canary_drift(responses: DataFrame) -> DataFrame:
    """Whether the canary's answers at the start and the end of a log are the same."""
    rows = responses.filter(F.coalesce("is_canary", F.lit(False)))
    ends = rows.groupBy(*LOG).agg(F.min_by("raw_output", "canary_position").alias("first"), F.max_by("raw_output", "canary_position").alias("last"), F.count("*").alias("canaries"))
    return ends.select(*LOG, "canaries", F.col("first").eqNullSafe(F.col("last")).alias("same"))


def repair_two_pass(responses: DataFrame, gold: DataFrame, whole_prompt: bool = False) -> DataFrame:
    """Last records, with those whose identifier list could not be read parsed anew.

    A list of nothing gives the query's text (status reprocessed_empty); otherwise the items are redacted
    in it (reprocessed_fixed). Records without a readable list stay. ``whole_prompt``: redact the stored
    prompt, where there is one, in place of the query's text.
    """
    rows = last_records(responses).join(gold.select("query_id", "query_text"), "query_id", "left")
    broken = ~F.coalesce("is_canary", F.lit(False)) & (F.coalesce("error", F.lit("")) == "json_parse_failure")
    items = F.when(broken & (F.coalesce("pass1_output", F.lit("")) != ""), json_items(F.col("pass1_output")))
    rows = rows.withColumn("_items", items)
    query = F.coalesce("query_text", "input_text", F.lit(""))
    base = F.coalesce(F.nullif("input_text", F.lit("")), "query_text", F.lit("")) if whole_prompt else query
    fixed = F.col("_items").isNotNull()
    nothing = F.size("_items") == 0
    return rows.select(
        *[c for c in responses.columns if c not in ("raw_output", "error", "parse_status")], "position",
        F.when(fixed & nothing, query).when(fixed, redact(base, F.col("_items"))).otherwise(F.col("raw_output")).alias("raw_output"),
        F.when(~fixed, F.col("error")).alias("error"),
        F.when(fixed & nothing, "reprocessed_empty").when(fixed, "reprocessed_fixed").otherwise(F.col("parse_status")).alias("parse_status"),
        F.when(fixed, "fixed").when(broken, "still_broken").alias("repair"),
    )


def repair_counts(repaired: DataFrame) -> DataFrame:
    return repaired.groupBy(*LOG).agg(F.count_if(F.col("repair") == "fixed").alias("fixed"), F.count_if(F.col("repair") == "still_broken").alias("still_broken"))


def draw(row: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row)))


def stratified_sample(gold: DataFrame, n: int = 100, positive_share: float = 0.79, seed: int = 42) -> DataFrame:
    """``n`` queries without replacement, ``positive_share`` of them with annotations (all there are, if
    fewer), in a seeded order. Each stratum is cut by a limit on the order, not by a window over all."""
    order = [draw("query_id", seed), "query_id"]
    positive = gold.filter(~F.col("is_negative")).orderBy(*order).limit(int(n * positive_share))
    n_pos = min(int(n * positive_share), gold.filter(~F.col("is_negative")).limit(int(n * positive_share)).count())
    negative = gold.filter("is_negative").orderBy(*order).limit(n - n_pos)
    place = F.row_number().over(Window.orderBy(draw("query_id", seed + 1), "query_id"))  # at most n rows
    return positive.unionByName(negative).withColumn("place", place)


def pilot(outputs: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each (model, prompt): how alike the runs of a log are, and how many runs to make.

    Failed calls count as empty outputs. ``identical``: share of queries with the same bytes in all runs;
    recall of each run over all values; similarity of every run with the first.
    """
    by = ["model", "prompt"]
    rows = without_canaries(outputs).select(*by, "run", "query_id", F.when(F.coalesce("error", F.lit("")) == "", F.coalesce("raw_output", F.lit(""))).otherwise("").alias("output"))
    rows = rows.join(gold.select("query_id", "phi_tags"), "query_id")
    runs = Window.partitionBy(*by, "query_id").orderBy("run")
    rows = rows.withColumn("_first", F.first("output").over(runs)).withColumn("_k", F.row_number().over(runs))
    similarity = F.when(F.col("_k") > 1, F.when(F.col("output") == F.col("_first"), 1.0).otherwise(levenshtein_similarity(F.col("_first"), F.col("output"))))
    removed = F.size(F.filter("phi_tags", lambda p: ~F.contains(F.lower("output"), F.lower(p["value"]))))
    each = rows.select(*by, "run", "query_id", F.sha2("output", 256).alias("hash"), similarity.alias("similarity"), removed.alias("removed"), F.size("phi_tags").alias("phi"))
    query = each.groupBy(*by, "query_id").agg((F.count_distinct("hash") == 1).alias("same"), F.sum("similarity").alias("s"), F.count("similarity").alias("n"))
    alike = query.groupBy(*by).agg(
        F.count("*").alias("queries"), F.count_if("same").alias("identical_count"), F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(1.0)).alias("mean_similarity")
    )
    recall = each.groupBy(*by, "run").agg(F.coalesce(F.try_divide(F.sum("removed").cast("double"), F.sum("phi")), F.lit(0.0)).alias("recall"))
    spread = recall.groupBy(*by).agg(
        F.count("*").alias("runs"), F.avg("recall").alias("recall_mean"), F.stddev_pop("recall").alias("recall_std"), (F.max("recall") - F.min("recall")).alias("recall_range")
    )
    out = alike.join(spread, by).withColumn("identical_rate", F.col("identical_count") / F.col("queries"))
    advice = F.when(F.col("identical_rate") >= 0.99, "N=3").when(F.col("recall_std") < 0.005, "N=5").otherwise("N=5_different_seeds")
    return out.withColumn("recommendation", advice)
