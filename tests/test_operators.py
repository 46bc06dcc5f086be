"""Scoring, aggregation, statistics and runs."""

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilmark import schemas
from veilmark.operators import evaluate, report, runs, stats
from veilmark.sources import clients, files, fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def gold(spark):
    return fixtures.gold(spark, SF).cache()


@pytest.fixture(scope="module")
def scores(spark, gold):
    return evaluate.score(fixtures.responses(gold), gold).cache()


def scored(spark, query, phi, output, error=None):
    gold = spark.createDataFrame([("q", query, [{"identifier_type": k, "value": v} for k, v in phi], len(phi), not phi)], schemas.QUERY)
    row = {"model": "m", "prompt": "p", "run": 1, "seq": 0, "query_id": "q", "raw_output": output, "error": error}
    names = [c.split()[0] for c in schemas.RESPONSE.split(", ")]
    rows = spark.createDataFrame([tuple(row.get(n) for n in [*names, "model", "prompt", "run", "seq"])], schemas.RESPONSE + ", model string, prompt string, run int, seq bigint")
    return evaluate.score(rows, gold).first()


def test_null_and_empty_outputs_differ(spark):
    phi = [("NAME", "Ann Lee")]
    assert scored(spark, "see Ann Lee", phi, None).tier1.recall == 0 and scored(spark, "see Ann Lee", phi, "").tier1.recall == 1
    none = scored(spark, "what dose", [], None)
    assert none.tier1.preserved and none.tier1.tags_found == 0 and none.tier3.failure_reason == "no_output" and none.fp_taxonomy is None
    assert scored(spark, "see Ann Lee", phi, "see [NAME]", error="timeout_120s").tier1.recall == 0


@pytest.mark.parametrize("offset, hit", [(80, True), (81, False)])
def test_a_tag_counts_up_to_80_characters_away(spark, offset, hit):
    row = scored(spark, "Ann Lee" + " " * 200, [("NAME", "Ann Lee")], "-" * offset + "[NAME]")
    assert row.tier2.phi_detected == int(hit) and row.elements[0].position_offset == (offset if hit else None)


def test_tier2_kinds(spark):
    two = scored(spark, "Ann Lee and Bob Ray came", [("NAME", "Ann Lee"), ("DATE", "Bob Ray")], "[REDACTED] came")
    assert two.tier2.phi_detected == 2 and two.tier2.recall == 1.0
    assert scored(spark, "no such", [("NAME", "Ann")], "no such").elements[0].reason == "phi_not_in_input"
    gone = scored(spark, "the nurse saw Ann Lee on the ward", [("NAME", "Ann Lee")], "the nurse saw on the ward")
    assert (gone.elements[0].reason, gone.elements[0].is_deletion) == ("deletion", True)
    assert scored(spark, "see Ann Lee", [("NAME", "Ann Lee")], "quite other").elements[0].reason == "no_matching_tag"
    unknown = scored(spark, "see Ann Lee", [("ODD", "Ann Lee")], "see [ID]")
    assert unknown.elements[0].tier2_pass is False and unknown.tier3["levenshtein_similarity"] == 1.0


def test_tier3_and_false_positives(spark):
    same = scored(spark, "what is the dose for asthma", [], "what is the dose for asthma")
    assert same.tier3["pass"] and same.tier3.char_ratio == 1.0 and same.tier3.failure_reason is None
    tagged = scored(spark, "what is the dose for asthma", [], "what is the dose for [NAME]")
    assert tagged.fp_taxonomy.type_a_count == 1 and tagged.fp_taxonomy.tagged_terms == ["[NAME]"] and not tagged.tier1.preserved
    long = scored(spark, "what dose", [], "what dose" + " " * 40 + "for example [NAME]" + " " * 60 + "was replaced [ID]" + " " * 60 + "*** odd")
    assert [long.fp_taxonomy[f"type_{x}_count"] for x in "abcd"] == [0, 2, 1, 0]
    assert scored(spark, "see Ann Lee", [("NAME", "Ann Lee")], "see [NAME] and Jane Roe").tier3.new_phi_detected


def test_invariants(scores):
    each = scores.filter("not is_negative").select(F.inline("elements"))
    assert each.filter("tier2_pass and not tier1_pass").count() == 0
    assert scores.filter("tier3.levenshtein_similarity not between 0 and 1").count() == 0
    assert scores.filter("not is_negative and abs(tier1.recall * phi_count - tier1.phi_detected) > 1e-9").count() == 0
    table = evaluate.aggregate(scores).collect()
    assert all(r.over_redaction == pytest.approx(1 - r.specificity_mean) for r in table)
    assert all(r.errors_total == r.errors_timeout + r.errors_parse + r.errors_other for r in table)
    assert all(r.t1_recall_mean == pytest.approx(np.mean(r.t1_recall_per_run), abs=1e-4) and r.t1_recall_with_errors <= r.t1_recall_mean for r in table)


def test_evaluation_documents(scores):
    rows = evaluate.as_documents(evaluate.aggregate(scores), evaluate.by_category(scores)).collect()
    assert len(rows) == 6 and rows[0].positive_queries.per_category["NAME"]["count"] > 0
    assert evaluate.as_documents(evaluate.aggregate(scores)).first().positive_queries.per_category == {}


def test_tables(scores):
    evaluation = evaluate.aggregate(scores).cache()
    assert report.comparison_table(evaluation).columns == schemas.COMPARISON and report.false_positive_table(scores).columns == schemas.FALSE_POSITIVES
    ranks = report.ranked(evaluation).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 7)) and sorted(r.rank_in_model for r in ranks) == [1, 1, 1, 2, 2, 2]
    assert r"\begin{tabular}{lll}" in report.latex_table(evaluation.select("model", "prompt", "t1_recall_mean"), "Recall")


def paired(spark, a, b):
    rows = [("a", str(i), x) for i, x in enumerate(a)] + [("b", str(i), x) for i, x in enumerate(b)]
    return spark.createDataFrame(rows, "config string, query_id string, ok boolean"), spark.createDataFrame([("t", "a", "b")], "comparison string, a string, b string")


def test_mcnemar(spark):
    few = stats.mcnemar(*paired(spark, [True] * 9, [True] * 9)).first()
    assert few.error == "insufficient_shared_queries" and few.statistic is None
    same = stats.mcnemar(*paired(spark, [True] * 10, [True] * 10)).first()
    assert (same.statistic, same.p_value, same.cohens_g) == (0.0, 1.0, 0.0)
    even = stats.mcnemar(*paired(spark, [True] * 3 + [False] * 3 + [True] * 6, [False] * 3 + [True] * 3 + [True] * 6)).first()
    assert even.statistic == 0.1667 and even.a_only == even.b_only == 3
    assert even.p_value == pytest.approx(math.erfc(math.sqrt(1 / 12)), abs=1e-6) and even.cohens_g_standard == 0.0


def test_cochran_q(spark):
    rng = np.random.default_rng(0)
    m = rng.random((30, 3)) < [0.9, 0.6, 0.3]
    rows = spark.createDataFrame([(f"c{j}", str(i), bool(m[i, j])) for i in range(30) for j in range(3)], "config string, query_id string, ok boolean")
    got = stats.cochran_q(rows, spark.createDataFrame([("f", f"c{j}") for j in range(3)] + [("g", "c0")], "family string, config string"))
    got = {r.family: r for r in got.collect()}
    c, t = m.sum(axis=0), m.sum(axis=1)
    assert got["f"].statistic == pytest.approx(2 * (3 * (c**2).sum() - t.sum() ** 2) / (3 * t.sum() - (t**2).sum()), abs=1e-4)
    assert got["f"].df == 2 and 0 < got["f"].p_value < 0.01 and got["g"].error == "need_at_least_2_configs"


def test_holm(spark):
    rows = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "idx int, p_value double")
    assert [r.p_value_corrected for r in stats.holm(rows).orderBy("idx").collect()] == [0.04, 0.09, 0.09, 1.0]


def test_bootstraps_agree(spark, scores):
    units = stats.bootstrap_units(scores).cache()
    hashed = {(r.model, r.prompt, r.metric): r for r in stats.bootstrap_hashed(units, 60).collect()}
    drawn = {(r.model, r.prompt, r.metric): r for r in stats.bootstrap(units, 400).collect()}
    assert hashed.keys() == drawn.keys() and len(drawn) == 24
    assert all(abs(hashed[k].mean - drawn[k].mean) < 0.03 and drawn[k].ci_lower <= drawn[k].mean <= drawn[k].ci_upper for k in drawn)


def test_numpy_bootstrap_draws_as_plain_loops_do():
    pos, neg = np.array([[1, 2, 0], [2, 2, 1], [0, 1, 3]], float), np.array([1, 0, 1, 1], float)
    got, rng = stats.resample(pos, neg, 50, 7), np.random.RandomState(7)
    for i in range(50):
        p, n = pos[rng.randint(0, 3, size=3)], neg[rng.randint(0, 4, size=4)]
        hit, phi, fp = p.sum(axis=0)
        r, q = hit / phi, hit / (hit + fp) if hit + fp else 0.0
        assert [got[k][i] for k in ("recall", "precision", "f1", "specificity")] == pytest.approx([r, q, 2 * r * q / (r + q) if r + q else 0.0, n.mean()])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=3, max_size=20))
def test_bca_is_ordered_and_in_range(x):
    lower, upper, estimate = stats.bca(np.array(x), np.mean, 200)
    assert min(x) - 1e-9 <= lower <= upper <= max(x) + 1e-9 and estimate == pytest.approx(np.mean(x))


def test_last_record_wins_and_canaries(spark, gold):
    log = fixtures.log_with_repeats(fixtures.responses(gold))
    last = runs.last_records(log)
    assert last.count() == log.select("model", "prompt", "run", "query_id").distinct().count() and last.filter("raw_output like '% again'").count() > 0
    assert {(r.run, r.same) for r in runs.canary_drift(log).collect()} == {(1, True), (2, True), (3, False)}
    assert evaluate.score(last, gold).filter("query_id like 'canary%'").count() == 0


def test_repair(spark, gold):
    fixed = runs.repair_two_pass(fixtures.item_answers(gold), gold)
    rows = {r.query_id: r for r in fixed.join(gold.drop("phi_count"), "query_id").collect()}
    for r in rows.values():
        form = r.key % 8
        broken = form in (6, 7) or (form in (1, 3, 4) and r.is_negative)  # no object, or nothing, to read
        assert (r.repair == "still_broken") == broken and (r.error is None) != broken
        if r.repair == "fixed":
            assert not any(p.value in r.raw_output for p in r.phi_tags) or form == 5
    assert runs.repair_two_pass(fixtures.item_answers(gold), gold, whole_prompt=True).filter("raw_output like '[USER]%'").count() > 0


def test_pilot_and_sample(spark, gold):
    sample = runs.stratified_sample(gold, 50)
    assert sample.count() == 50 and sample.filter("not is_negative").count() == 39 and [r.place for r in sample.orderBy("place").collect()] == list(range(1, 51))
    one = fixtures.responses(gold).filter("run = 1").withColumn("error", F.lit(None).cast("string"))
    same = runs.pilot(one.unionByName(one.withColumn("run", F.lit(2))), gold).first()
    assert (same.identical_rate, same.mean_similarity, same.recall_range, same.recommendation) == (1.0, 1.0, 0.0, "N=3")


PROMPT = {"slug": "p", "system_prompt": "s", "user_template": "Redact.\n\n{query}", "output_parser": "direct"}
TWO = {"slug": "t", "system_prompt": "list as JSON", "pass1_user_template": "Find.\n\nText: {query}", "output_parser": "json_then_replace"}


def test_responding_in_one_and_two_passes(spark, gold):
    one = clients.run_log(gold, None, "rules", PROMPT, 1, clients.rule_client, canary="Customer#1 came")
    assert one.count() == gold.count() + 2 and one.filter("query_id = 'canary_end'").first().canary_position == 1052
    two = clients.run_log(gold, None, "rules", TWO, 1, clients.rule_client)
    both = {r.query_id: r.raw_output for r in one.collect()}
    assert all(r.raw_output == both[r.query_id] for r in two.collect())
    llm = TWO | {"output_parser": "json_then_llm_replace", "pass2_system_prompt": "s", "pass2_user_template": "{phi_json}\n\n{query}"}
    again = clients.run_log(gold, two.filter("query_id like 'P-%'").withColumn("prompt", F.lit("t")), "rules", llm, 1, clients.rule_client)
    assert again.count() == gold.filter("is_negative").count() and again.filter("pass2_method <> 'llm' or raw_output is null").count() == 0


def test_retries(spark):
    calls = []

    def flaky(system, user, params):
        calls.append(user)
        return clients.Reply(error="timeout_120s") if len(calls) < 3 else clients.Reply("ok")

    assert clients.retrying(flaky, 2, 0)("", "x", {}).raw_output == "ok" and len(calls) == 3
    assert clients.http_client("http://127.0.0.1:9", "m", 0.2)("", "", {}).error.startswith("connection_error")


def test_numpy_draws_counted_by_kind():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 1), (5, 64), (1000, 1025)):
        pos, neg = rng.integers(0, 40, (n, 3)).astype(float), rng.integers(0, 2, m).astype(float)
        got, plain = stats.resample(pos, neg, 20, 3), np.random.RandomState(3)
        for k in range(20):
            hit, phi, _ = pos[plain.randint(0, n, size=n)].sum(axis=0)
            assert got["recall"][k] == (hit / phi if phi else 0)
            assert got["specificity"][k] == neg[plain.randint(0, m, size=m)].sum() / m


def test_bca_of_a_large_group_of_few_values():
    x = np.sort(np.random.default_rng(5).integers(0, 5, 200_000) / 4)
    began = time.time()
    lower, upper, estimate = stats.bca(x, np.mean, 100)
    assert lower < estimate < upper and estimate == pytest.approx(x.mean()) and time.time() - began < 20
    assert stats.bca(x[:500], np.mean, 100) == pytest.approx(stats.bca(x[:500], lambda v: v.mean(), 100), abs=1e-12)
    again = stats.jackknife(x[::1000], np.median)
    assert list(again) == [np.median(np.delete(x[::1000], i)) for i in range(200)]
    assert stats.jackknife(x[::1000], np.mean) == pytest.approx([np.mean(np.delete(x[::1000], i)) for i in range(200)], abs=1e-12)
