"""Scoring of responses and aggregation over runs and configurations.

All configurations go through one plan: the join with the annotated queries, column expressions, then
aggregates by (model, prompt, run) and by (model, prompt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import find_tags
from ..functions.text import levenshtein_similarity, new_identifiers
from . import tiers

KEYS = ["model", "prompt"]


def has_error(error: str = "error") -> Column:
    """Null and the empty text are no errors."""
    return F.coalesce(F.col(error), F.lit("")) != ""


def without_canaries(responses: DataFrame) -> DataFrame:
    return responses.filter(~F.coalesce("is_canary", F.lit(False)))


def judged_output() -> Column:
    """The extracted output unless empty, else the raw one; null on an error."""
    return F.when(has_error(), None).otherwise(F.coalesce(F.nullif("extracted_output", F.lit("")), "raw_output"))


def unknown_queries(responses: DataFrame, gold: DataFrame) -> DataFrame:
    """Responses to queries that the gold set has not; scoring leaves them out."""
    return without_canaries(responses).join(gold.select("query_id"), "query_id", "left_anti")


def score(responses: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each response (canaries and unknown queries aside) with its three tiers.

    ``elements`` holds tiers 1 and 2 of each annotated value (positives), ``tags`` every tag found.
    Which side of the join is sent to the other is left to the planner, which knows the sizes.
    """
    rows = without_canaries(responses).join(gold, "query_id").withColumn("output", judged_output())
    rows = rows.withColumns(
        {
            "is_negative": F.coalesce("is_negative", F.size("phi_tags") == 0),
            "phi_count": F.coalesce("phi_count", F.size("phi_tags")),
            "tags": F.coalesce(find_tags(F.col("output")), F.array()),
        }
    )
    query, phi, output, tags, negative = (F.col(c) for c in ("query_text", "phi_tags", "output", "tags", "is_negative"))
    rows = rows.withColumn("elements", F.when(~negative, tiers.elements(query, phi, output, tags)))
    rows = rows.withColumn("expected", F.when(negative, query).otherwise(tiers.expected_output(query, phi)))
    rows = rows.withColumns({"similarity": levenshtein_similarity(F.col("expected"), output), "fresh": new_identifiers(output, query)})
    passed = lambda tier: F.size(F.filter("elements", lambda e: e[tier]))
    recall = lambda tier: F.when(output.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(passed(tier).cast("double"), F.size("elements")), F.lit(1.0)))
    positive = ~negative
    tier1 = F.struct(
        F.when(positive, passed("tier1_pass")).alias("phi_detected"),
        F.when(positive, F.size("elements") - passed("tier1_pass")).alias("phi_missed"),
        F.when(positive, recall("tier1_pass")).alias("recall"),
        F.when(positive, F.transform(F.filter("elements", lambda e: ~e["tier1_pass"]), lambda e: e["value"])).alias("missed_values"),
        F.when(negative, F.size(tags)).alias("tags_found"),
        F.when(negative, F.transform(tags, lambda t: t["tag_text"])).alias("tag_list"),
        F.when(negative, F.transform(tags, lambda t: t["tag_type"])).alias("tag_types"),
        F.when(negative, F.transform(tags, lambda t: t["format"])).alias("tag_formats"),
        F.when(negative, F.size(tags) == 0).alias("preserved"),
    )
    tier2 = F.struct(
        F.when(positive, passed("tier2_pass")).alias("phi_detected"),
        F.when(positive, F.size("elements") - passed("tier2_pass")).alias("phi_missed"),
        F.when(positive, recall("tier2_pass")).alias("recall"),
        F.when(negative, F.size(tags)).alias("tags_found"),
        F.when(negative, F.size(tags) == 0).alias("preserved"),
    )
    return rows.select(
        *KEYS, "run", "seq", "query_id", "is_negative", "phi_count", F.coalesce("parse_status", F.lit("clean")).alias("parse_status"),
        "elements", tier1.alias("tier1"), tier2.alias("tier2"),
        tiers.fidelity(negative, output, F.col("expected"), F.col("similarity"), F.col("fresh")).alias("tier3"),
        F.when(negative, tiers.false_positives(query, output, tags)).alias("fp_taxonomy"),
        F.when(positive, F.transform(tags, lambda t: t["tag_text"])).alias("all_detected_tags"),
        F.coalesce("latency_ms", F.lit(-1)).cast("long").alias("latency_ms"), F.coalesce("tokens_output", F.lit(0)).cast("long").alias("tokens_output"),
        "error", F.coalesce("output_truncated", F.lit(False)).alias("output_truncated"),
    )


def _share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def by_run(scores: DataFrame) -> DataFrame:
    """Rates of each (model, prompt, run); null where a run has no row that counts."""
    fine = ~has_error()
    pos, neg = fine & ~F.col("is_negative"), fine & F.col("is_negative")
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0))
    phi, tags = total(pos, F.col("phi_count")), total(pos, F.size("all_detected_tags"))
    hit1, hit2 = total(pos, F.col("tier1.phi_detected")), total(pos, F.col("tier2.phi_detected"))
    some = F.count_if(pos) > 0
    return scores.groupBy(*KEYS, "run").agg(
        F.when(some, _share(hit1, phi)).alias("t1_recall"),
        F.when(some, _share(hit2, phi)).alias("t2_recall"),
        F.when(tags > 0, hit2.cast("double") / tags).alias("t2_precision"),
        F.avg(F.when(fine, F.col("tier3.pass").cast("double"))).alias("t3_pass"),
        F.avg(F.when(fine, F.col("tier3.levenshtein_similarity"))).alias("t3_similarity"),
        F.avg(F.when(neg, F.col("tier1.preserved").cast("double"))).alias("specificity"),
        F.avg(F.when(~F.col("is_negative"), F.coalesce(F.when(fine, F.col("tier1.phi_detected") / F.greatest("phi_count", F.lit(1))), F.lit(0.0)))).alias("t1_recall_with_errors"),
    )


def _over_runs(rates: DataFrame) -> DataFrame:
    """Mean, population deviation (0 for one run) and the list, in run order, of each rate."""
    names = ["t1_recall", "t2_recall", "t2_precision", "t3_pass", "t3_similarity", "specificity"]
    out = []
    for x in names:
        per_run = F.transform(F.array_sort(F.collect_list(F.when(F.col(x).isNotNull(), F.struct("run", F.col(x).alias("rate"))))), lambda s: F.bround(s["rate"], 4))
        out += [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{x}_mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias(f"{x}_std"), per_run.alias(f"{x}_per_run")]
    return rates.groupBy(*KEYS).agg(*out, F.avg("t1_recall_with_errors").alias("t1_recall_with_errors"))


def aggregate(scores: DataFrame) -> DataFrame:
    """One row for each (model, prompt): rates over runs, counts, error classes, kinds of false positives,
    latency.

    Failed responses count in no rate, so that time-outs do not lower recall; ``t1_recall_with_errors``
    is the mean over positives in which they count as no recall. An error with both words is in two
    classes.
    """
    bad = has_error()
    text = F.when(bad, F.col("error"))
    fp = lambda x: F.coalesce(F.sum(F.when(~bad, F.col(f"fp_taxonomy.type_{x}_count"))), F.lit(0)).alias(f"fp_type_{x}")
    latency = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    cuts = F.percentile(latency, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    runs = F.count_distinct("run")
    wholes = scores.groupBy(*KEYS).agg(
        runs.alias("runs_completed"), F.floor(F.count("*") / F.greatest(runs, F.lit(1))).alias("queries_per_run"), F.count("*").alias("total_inferences"),
        F.count_if(bad).alias("errors_total"), F.count_if(F.contains(text, F.lit("timeout"))).alias("errors_timeout"), F.count_if(F.contains(text, F.lit("parse"))).alias("errors_parse"),
        F.count_if(bad & ~F.contains(text, F.lit("timeout")) & ~F.contains(text, F.lit("parse"))).alias("errors_other"),
        F.count_distinct(F.when(~bad & ~F.col("is_negative"), F.col("query_id"))).alias("positive_count"),
        F.count_distinct(F.when(~bad & F.col("is_negative"), F.col("query_id"))).alias("negative_count"),
        *[fp(x) for x in "abcd"],
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("latency_mean_ms"), F.coalesce(cuts[0], F.lit(0.0)).alias("latency_median_ms"),
        F.coalesce(cuts[1], F.lit(0.0)).alias("latency_p95_ms"), F.coalesce(cuts[2], F.lit(0.0)).alias("latency_p99_ms"),
    )
    out = _over_runs(by_run(scores)).join(wholes, KEYS)
    return out.withColumn("over_redaction", 1 - F.col("specificity_mean"))


def by_category(scores: DataFrame) -> DataFrame:
    """Tier-1 recall of each identifier type in each configuration."""
    # explode_outer: plain explode has the optimizer test the elements first, working them out anew
    each = scores.filter(~has_error() & ~F.col("is_negative")).select(*KEYS, F.explode_outer("elements").alias("e")).filter("e.tier1_pass is not null")
    counts = each.groupBy(*KEYS, F.col("e.type").alias("phi_category")).agg(F.count("*").alias("count"), F.count_if(F.col("e.tier1_pass")).alias("detected"))
    return counts.withColumn("recall", F.col("detected") / F.col("count"))


def as_documents(evaluation: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """``aggregate`` in its nested form, as it is written to evaluation files."""
    if categories is None:
        filled = evaluation.withColumn("per_category", F.create_map().cast("map<string, struct<recall double, count bigint, detected bigint>>"))
    else:
        nested = categories.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("phi_category", F.struct("recall", "count", "detected")))).alias("per_category"))
        filled = evaluation.join(nested, KEYS, "left")
    tier = lambda x, **more: F.struct(*[F.col(f"{c}").alias(a) for a, c in more.items()]).alias(x)
    return filled.select(
        F.col("model").alias("model_name"), F.col("prompt").alias("prompt_style"), "runs_completed", "queries_per_run", "total_inferences",
        tier("errors", total_failures="errors_total", timeout="errors_timeout", parse_error="errors_parse", other="errors_other"),
        F.struct(
            F.col("positive_count").alias("count"),
            tier("tier1", recall_mean="t1_recall_mean", recall_std="t1_recall_std", recall_per_run="t1_recall_per_run"),
            tier("tier2", recall_mean="t2_recall_mean", recall_std="t2_recall_std", recall_per_run="t2_recall_per_run",
                 precision_mean="t2_precision_mean", precision_std="t2_precision_std", precision_per_run="t2_precision_per_run"),
            tier("tier3", fidelity_pass_rate_mean="t3_pass_mean", fidelity_pass_rate_per_run="t3_pass_per_run",
                 similarity_mean="t3_similarity_mean", similarity_std="t3_similarity_std", similarity_per_run="t3_similarity_per_run"),
            "per_category",
        ).alias("positive_queries"),
        F.struct(
            F.col("negative_count").alias("count"),
            tier("tier1", specificity_mean="specificity_mean", specificity_std="specificity_std", specificity_per_run="specificity_per_run"),
            tier("fp_taxonomy", type_a="fp_type_a", type_b="fp_type_b", type_c="fp_type_c", type_d="fp_type_d"),
        ).alias("negative_queries"),
        F.struct(*[F.bround(f"latency_{x}_ms", 1).alias(f"{x}_ms") for x in ("mean", "median", "p95", "p99")]).alias("latency"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )
