"""Queries over whole tables, one for each operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonitems import json_items
from ..functions.tags import find_tags, register_tags
from ..functions.text import direct_answer, levenshtein_similarity, redact, repeats, runaway, section_answer
from ..operators import evaluate, quantiles, report, resampling, runs, stats
from ..sources import files, fixtures

Query = Callable[[SparkSession, str], DataFrame]
#: Contrasts and families of the paired tests: (name, configurations).
CONTRASTS = (("a", "alpha/zero-shot", "beta/zero-shot"), ("b", "alpha/few-shot", "alpha/zero-shot"), ("c", "beta/few-shot", "gamma/few-shot"), ("d", "alpha/zero-shot", "absent/zero-shot"))
FAMILIES = {"models": ("alpha/zero-shot", "beta/zero-shot", "gamma/zero-shot"), "prompts": ("beta/few-shot", "beta/zero-shot"), "one": ("alpha/few-shot",)}


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = fixtures.gold(spark, sf_dir)
    return evaluate.score(fixtures.responses(gold), gold)


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.aggregate(_scores(spark, sf_dir))


def _rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    """Doubles to ten digits: sums in another order may differ in the last bits."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.typeName() == "double"})


def config_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_evaluation(spark, sf_dir).select("model", "prompt", "t1_recall_mean", "t1_recall_std", "over_redaction"))


def tag_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.responses(fixtures.gold(spark, sf_dir)).select("model", "prompt", "run", "query_id", F.inline(find_tags(F.col("raw_output"))))
    return rows.drop("pattern_no")


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", find_tags(F.col("text")).alias("tags"))
    return docs.select("doc_id", F.size("tags").alias("n_tags"), F.get("tags", F.lit(0))["position"].alias("first_position"))


def tag_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of documents by the table function, from SQL text."""
    register_tags(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql("select d.doc_id, x.position, x.tag_text, x.tag_type, x.format from {docs} d, lateral veilmark_tags(d.text) x", docs=docs)


def tier1_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).select("model", "prompt", "run", "query_id", "tier1.*")
    return _rounded(rows.select("model", "prompt", "run", "query_id", "phi_detected", "phi_missed", "recall", F.array_join("missed_values", "|").alias("missed_values"), "tags_found", "preserved"))


def tier2_per_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    # inline_outer: plain inline has the optimizer test the elements before they are exploded, working them out anew
    rows = _scores(spark, sf_dir).select("model", "prompt", "run", "query_id", F.inline_outer("elements"))
    return rows.filter("tier1_pass is not null")


def tier3_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("model", "prompt", "run", "query_id", "tier3.*").withColumnRenamed("pass", "passed")


def fp_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.false_positive_table(_scores(spark, sf_dir))


def fp_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents returned as they are: whatever looks like a tag in them is a false positive."""
    gold = fixtures.natural_gold(spark, sf_dir)
    responses = fixtures.responses(gold).filter("model = 'alpha' and prompt = 'few-shot' and run = 1")
    same = responses.withColumns({"error": F.lit(None).cast("string"), "raw_output": F.substring("input_text", len("[USER] ") + 1, 2**31 - 1)})
    return report.false_positive_table(evaluate.score(same, gold))


def redact_programmatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform("phi_tags", lambda p: F.struct(p["value"].alias("text"), p["identifier_type"].alias("type")))
    return fixtures.gold(spark, sf_dir).select("query_id", redact(F.col("query_text"), items).alias("redacted"))


def category_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.category_table(evaluate.by_category(_scores(spark, sf_dir)))


def evaluation_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluation(spark, sf_dir)
    lists = {c: _listed(c) for c, kind in rows.dtypes if kind.startswith("array")}
    return _rounded(rows.withColumns(lists))


def _listed(name: str) -> Column:
    """The numbers of an array as text."""
    return F.array_join(F.col(name).cast("array<string>"), ",")


def evaluation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the nested documents side by side, lists and categories as text."""
    scores = _scores(spark, sf_dir)
    docs = evaluate.as_documents(evaluate.aggregate(scores), evaluate.by_category(scores))
    pos, neg, by_type = "positive_queries", "negative_queries", F.array_sort(F.map_entries("positive_queries.per_category"))
    category = lambda e: F.concat_ws("/", e["key"], F.bround(e["value"]["recall"], 4).cast("string"), e["value"]["count"], e["value"]["detected"])
    lists = [(f"{pos}.tier1", "recall"), (f"{pos}.tier2", "recall"), (f"{pos}.tier2", "precision"), (f"{pos}.tier3", "similarity"), (f"{neg}.tier1", "specificity")]
    each = []
    for tier, rate in lists:
        name = f"{tier.replace('.', '_')}_{rate}"
        each += [F.col(f"{tier}.{rate}_mean").alias(f"{name}_mean"), F.col(f"{tier}.{rate}_std").alias(f"{name}_std"), _listed(f"{tier}.{rate}_per_run").alias(f"{name}_per_run")]
    return _rounded(
        docs.select(
            "model_name", "prompt_style", "runs_completed", "queries_per_run", "total_inferences", "errors.total_failures", "errors.timeout", "errors.parse_error", "errors.other",
            F.col(f"{pos}.count").alias("positive_count"), F.col(f"{neg}.count").alias("negative_count"), *each, F.col(f"{pos}.tier3.fidelity_pass_rate_mean").alias("fidelity_mean"),
            _listed(f"{pos}.tier3.fidelity_pass_rate_per_run").alias("fidelity_per_run"), F.array_join(F.transform(by_type, category), ",").alias("per_category"),
            *[F.col(f"{neg}.fp_taxonomy.type_{x}") for x in "abcd"], *[F.col(f"latency.{x}_ms") for x in ("mean", "median", "p95", "p99")],
            F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("timestamp_fits"),
        )
    )


def recall_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.by_run(_scores(spark, sf_dir)))


def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.comparison_table(_evaluation(spark, sf_dir))


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).select("model", "prompt", "errors_total", "errors_timeout", "errors_parse", "errors_other", "total_inferences", "queries_per_run")


def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.error_rates(_evaluation(spark, sf_dir)))


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    positive = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value > 0")
    cuts = quantiles.exact_percentiles(positive, ["event_type"], "value", [0.5, 0.95, 0.99])
    rows = positive.groupBy("event_type").agg(F.avg("value").alias("mean")).join(cuts, "event_type")
    return _rounded(rows.select("event_type", "mean", F.col("cuts")[0].alias("median"), F.col("cuts")[1].alias("p95"), F.col("cuts")[2].alias("p99")))


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.log_with_repeats(fixtures.responses(fixtures.gold(spark, sf_dir)))
    return runs.last_records(log).select("model", "prompt", "run", "query_id", "seq", "position", "raw_output", "error")


def duplicates_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.duplicates_removed(fixtures.log_with_repeats(fixtures.responses(fixtures.gold(spark, sf_dir))))


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = fixtures.gold(spark, sf_dir)
    models, prompts = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in (("model", fixtures.MODELS), ("prompt", fixtures.PROMPTS)))
    return runs.todo(gold, fixtures.responses(gold), runs.configurations(models, prompts, fixtures.RUNS), retry_errors=True)


def unknown_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = fixtures.gold(spark, sf_dir)
    return evaluate.unknown_queries(fixtures.responses(gold), gold.filter("not is_negative")).select("model", "prompt", "run", "query_id")


def canary_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.canary_drift(fixtures.log_with_repeats(fixtures.responses(fixtures.gold(spark, sf_dir))))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outcomes(_scores(spark, sf_dir)).select(stats.config().alias("config"), "query_id", "ok")


def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrasts = spark.createDataFrame(CONTRASTS, "comparison string, a string, b string")
    return _rounded(stats.mcnemar(_paired(spark, sf_dir), contrasts))


def mcnemar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality against toxicity of the labelled documents, as two classifiers of the same rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    each = labels.select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("quality"), F.lit("clean")), F.array(F.col("quality"), 1 - F.col("toxic")))).alias("config", "x"))
    paired = each.select("config", F.col("doc_id").cast("string").alias("query_id"), (F.col("x") == 1).alias("ok"))
    return _rounded(stats.mcnemar(paired, spark.createDataFrame([("labels", "quality", "clean")], "comparison string, a string, b string")))


def cochran_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = spark.createDataFrame([(f, c) for f, cs in FAMILIES.items() for c in cs], "family string, config string")
    return _rounded(stats.cochran_q(_paired(spark, sf_dir), families))


def cochran_q_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether users are seen alike often in each type of event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users, types = events.select("user_id").distinct(), events.select("event_type").distinct()
    seen = events.select("user_id", "event_type").distinct().withColumn("seen", F.lit(True))
    grid = users.crossJoin(F.broadcast(types))  # the five types of events for each user
    paired = grid.join(seen, ["user_id", "event_type"], "left").select(F.col("event_type").alias("config"), F.col("user_id").cast("string").alias("query_id"), F.coalesce("seen", F.lit(False)).alias("ok"))
    return _rounded(stats.cochran_q(paired, types.select(F.lit("events").alias("family"), F.col("event_type").alias("config"))))


def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's correction of one made-up p-value for each nation, within its region."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tests = nations.select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("idx"), (F.pmod(F.col("n_nationkey") * 37, F.lit(25)) / 250).alias("p_value"))
    return _rounded(stats.holm(tests, by=["family"]))


def jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = stats.bootstrap_units(_scores(spark, sf_dir)).filter("not is_negative")
    return _rounded(stats.jackknife_ratio(units, "hit", "phi_count", ["model", "prompt"]).select("model", "prompt", "unit", "left_out"))


def bootstrap_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.bootstrap_hashed(stats.bootstrap_units(_scores(spark, sf_dir)), 20))


def bootstrap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resampling.bootstrap_rates(stats.bootstrap_rows(_scores(spark, sf_dir)), ["model", "prompt"]))


def bootstrap_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap(stats.bootstrap_units(_scores(spark, sf_dir)))


def bootstrap_bca(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = stats.bootstrap_units(_scores(spark, sf_dir)).filter("not is_negative").withColumn("recall", F.col("hit") / F.col("phi_count"))
    return stats.bootstrap_bca(units, ["model", "prompt"], "recall")


def bca_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the recall over all values: a ratio of sums, by replicates that are sums themselves."""
    rows = stats.bootstrap_rows(_scores(spark, sf_dir)).filter("not is_negative")
    key = F.concat_ws(":", F.lit("0"), "query_id", "run", "seq")
    return _rounded(resampling.bca(rows, ["model", "prompt"], key, resampling.ratio_of("hit", "phi_count")), 6)


def phi_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.item_answers(fixtures.gold(spark, sf_dir)).select("query_id", json_items(F.col("pass1_output")).alias("items"))
    return rows.select("query_id", F.size("items").alias("n_items"), F.array_join(F.transform("items", lambda x: x["text"]), "|").alias("texts"))


def two_pass_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = fixtures.gold(spark, sf_dir)
    return runs.repair_two_pass(fixtures.item_answers(gold), gold).select("query_id", "raw_output", "error", "parse_status", "repair")


def direct_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.gold(spark, sf_dir).select("query_id", "query_text", F.pmod("key", F.lit(6)).alias("form"))
    prefixes = ["", "Output: ", " result:  Answer: ", "Output: Result:", "Here is the de-identified text:\n", "Note: "]
    made = F.concat(F.element_at(F.array(*[F.lit(x) for x in prefixes]), F.col("form").cast("int") + 1), "query_text", F.lit("  \n"))
    return raw.select("query_id", direct_answer(made).alias("answer"))


def cot_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in all forms that the extractor tells apart, by the query's number."""
    rows = fixtures.responses(fixtures.gold(spark, sf_dir)).filter("model = 'alpha' and prompt = 'few-shot' and run = 1")
    gold = fixtures.gold(spark, sf_dir).select("query_id", "query_text", "key")
    output, number = F.coalesce("raw_output", F.lit("")), F.col("key").cast("string")
    forms = [
        F.concat(F.lit("STEP 1: none\nOUTPUT: "), output), F.concat(F.lit("I read it.\n\n"), output), output,
        F.concat(F.lit("Begin\n"), F.repeat(F.concat(F.lit("line "), number, F.lit("\n")), F.lit(3))),
        F.concat(F.lit("Begin\nhere\n"), F.repeat(F.concat(F.lit("one two three four five six seven eight nine "), number, F.lit(" ")), F.pmod("key", F.lit(5)).cast("int"))),
        F.concat(F.repeat(F.lit("word "), F.pmod("key", F.lit(3)).cast("int") + 199), F.lit("end"), F.when(F.pmod("key", F.lit(2)) == 0, ".").otherwise("")),
        F.concat(F.lit("caf"), F.repeat(F.lit("é"), F.pmod("key", F.lit(3)).cast("int")), F.lit(" 1234567890")), F.concat(F.lit("OUTPUT:  "), F.lit("\n\nnothing more"), number),
    ]
    text = F.element_at(F.array(*forms), F.pmod("key", F.lit(8)).cast("int") + 1)
    joined = rows.join(gold, "query_id").select("query_id", section_answer(text, F.col("query_text")).alias("a"))
    return joined.select("query_id", F.col("a.text").alias("answer"), F.col("a.status").alias("status"))


def text_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold equal lines in a row, or a run of words again and again."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", repeats(F.coalesce("text", F.lit(""))).alias("repeated"))


def runaway_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.turns(spark, sf_dir).select("conv_id", "turn", runaway(F.col("output"), F.col("query")).alias("runaway"))


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.turns(spark, sf_dir).select("conv_id", "turn", levenshtein_similarity(F.col("query"), F.col("output")).alias("similarity"))


def pilot_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = fixtures.gold(spark, sf_dir)
    return _rounded(runs.pilot(fixtures.responses(gold), gold))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stratified_sample(fixtures.gold(spark, sf_dir)).select("query_id", "is_negative", "place")


def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.type_distribution(fixtures.natural_gold(spark, sf_dir))


def complexity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.complexity_histogram(fixtures.natural_gold(spark, sf_dir))


def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.metadata(fixtures.gold(spark, sf_dir)).select("total_queries", "positive_queries", "negative_queries", "total_phi_elements")


def best_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.best_by_metric(_rounded(_evaluation(spark, sf_dir))))


def nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.nearest_to_target(_evaluation(spark, sf_dir)))


def strategy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = report.pivot(_evaluation(spark, sf_dir), "t1_recall_mean", list(fixtures.PROMPTS))
    return _rounded(table.withColumnsRenamed({p: p.replace("-", "_") for p in fixtures.PROMPTS}))


def rank_in_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.ranked(_evaluation(spark, sf_dir)))


def strategy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.mean_of(_evaluation(spark, sf_dir), "t1_recall_mean", list(fixtures.PROMPTS)))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        config_summary, tag_detect, tag_counts, tag_lateral, tier1_per_query, tier2_per_element, tier3_per_query, fp_taxonomy, fp_natural,
        redact_programmatic, category_recall, evaluation_full, evaluation_documents, recall_by_run, comparison_table, error_classes,
        error_rates, latency_stats, dedup_last, duplicates_removed, resume_todo, unknown_queries, canary_drift, mcnemar, mcnemar_labels,
        cochran_q, cochran_q_events, holm, jackknife, bootstrap_hash, bootstrap_poisson, bootstrap_numpy, bootstrap_bca, bca_recall, phi_json_parse, two_pass_repair,
        direct_parse, cot_extract, text_repetition, runaway_turns, turn_similarity, pilot_identity, stratified_sample, type_distribution,
        complexity_histogram, dataset_metadata, best_per_metric, nearest_target, strategy_pivot, rank_in_model, strategy_mean,
    )
}
