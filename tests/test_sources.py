"""Readers, writers and the stream, by round trips."""

import json
from unittest import mock

import pytest
from pyspark.sql import functions as F

from veilmark.functions.tags import find_tags, register_tags
from veilmark.operators import evaluate, incremental, runs
from veilmark.sources import files, fixtures
from veilmark.streaming import live

SF = "/root/testdata/sf0.001"
TEXT = """===QUERY===
Ann Lee was seen
on Monday
===PHI_TAGS===
{"identifier_type": "NAME", "value": "Ann Lee"}
not json
{"identifier_type": "DATE", "value": "Monday"}
===QUERY===

===QUERY===
no delimiter
===QUERY===
what dose?
===PHI_TAGS===
"""


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    rows = files.read_delimited(spark, str(tmp_path / "a.txt")).orderBy("query_id").collect()
    assert [(r.query_id, r.query_text, [tuple(p) for p in r.phi_tags], r.is_negative) for r in rows] == [
        ("Q-0001", "Ann Lee was seen\non Monday", [("NAME", "Ann Lee"), ("DATE", "Monday")], False), ("Q-0003", "what dose?", [], True)
    ]


def test_dataset_round_trip(spark, tmp_path):
    gold = fixtures.gold(spark, SF).drop("key")
    files.write_dataset(gold, str(tmp_path / "gold"), dataset="g")
    again = files.read_dataset(spark, str(tmp_path / "gold"))
    assert sorted(map(str, again.collect())) == sorted(map(str, gold.collect()))
    assert files.check_counts(gold, 150, 200, 600) == [] and files.check_counts(gold, 1, 200, 600) == ["expected 1 positive queries, found 150"]


def test_queries_in_lines_with_their_metadata(spark, tmp_path):
    gold = fixtures.gold(spark, SF).drop("key").repartition(3)
    files.write_queries(gold, str(tmp_path / "gold"), dataset="g")
    again, about = files.read_queries(spark, str(tmp_path / "gold"))
    assert sorted(map(str, again.collect())) == sorted(map(str, gold.collect())) and len(list((tmp_path / "gold" / "queries").glob("*.json"))) == 3
    row = about.first()
    assert (row.dataset, row.total_queries, row.total_phi_elements) == ("g", 350, 600) and row.phi_type_distribution["NAME"] == 150


def test_logs(spark, tmp_path):
    folder = tmp_path / "raw" / "m" / "p" / "run_2"
    folder.mkdir(parents=True)
    lines = [json.dumps({"query_id": f"Q-{i}", "raw_output": "x"}) for i in (3, 1, 2)]
    (folder / "responses.jsonl").write_text("\n".join([lines[0], "{broken", *lines[1:], ""]))
    rows = files.read_responses(spark, f"{tmp_path}/raw/*/*/run_*/responses.jsonl").orderBy("seq").collect()
    assert [(r.query_id, r.model, r.prompt, r.run) for r in rows] == [(f"Q-{i}", "m", "p", 2) for i in (3, 1, 2)]
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        files.read_responses(spark, f"{tmp_path}/raw/*/*/run_*/responses.jsonl", strict=True).collect()


def test_append_and_resume(spark, tmp_path):
    gold = fixtures.gold(spark, SF)
    rows = fixtures.responses(gold)
    log = str(tmp_path / "log")
    files.append_responses(rows.filter("run = 1"), log)
    files.append_responses(rows.filter("run = 2"), log)
    again = files.read_log(spark, log)
    assert again.count() == rows.filter("run < 3").count() and "PartitionFilters: [isnotnull(run" in again.filter("run = 2")._jdf.queryExecution().toString()


def test_tables_and_configuration(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "t"))
    assert next((tmp_path / "t").glob("*.csv")).read_text() == "x,y\na,1\n"
    (tmp_path / "c.json").write_text(json.dumps({"_note": {}, "P1": {"slug": "a", "system_prompt": "s", "user_template": "t", "content_hash": "bad"}}))
    templates = files.read_config(spark, str(tmp_path / "c.json"))
    prompts = files.prompts(spark, templates)
    assert prompts.count() == 1 and prompts.select(files.same_hash(prompts).alias("ok")).first().ok is False
    assert files.parameters({"a": 1, "b": 1}, {"b": 2, "notes": "x"}, {"c": 3}) == {"a": 1, "b": 2, "c": 3}
    with pytest.raises(ValueError):
        files.by_slug([{"slug": "a"}], "b")


def test_stream_scores_each_first_record(spark, tmp_path):
    gold = fixtures.gold(spark, SF)
    rows = fixtures.responses(gold).filter("run = 1 and model = 'alpha'")
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    files.append_responses(rows.unionByName(rows.filter("query_id = 'P-7'")), log)
    query = live.start(live.live_scores(live.response_stream(spark, log), gold), out, str(tmp_path / "check"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(out)
    batch = evaluate.score(rows, gold)
    assert got.count() == batch.count() and got.agg(F.sum("tier1.phi_detected")).first() == batch.agg(F.sum("tier1.phi_detected")).first()


def test_stream_and_batch_agree_on_the_last_record(spark, tmp_path):
    gold = fixtures.gold(spark, SF)
    rows = fixtures.responses(gold).filter("run = 1 and model = 'alpha'")
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    later = rows.filter("seq % 5 = 0").withColumns({"seq": F.col("seq") + 1_000_000, "raw_output": F.lit("[NAME] again")})
    early = rows.filter("seq % 7 = 0").withColumns({"seq": F.col("seq") - 1_000_000, "raw_output": F.lit("too late")})

    def advance():
        assert live.start_corrections(live.corrections(live.response_stream(spark, log, 2), gold), out, str(tmp_path / "check")).awaitTermination(180) is not False

    for part in (rows, later, early.unionByName(rows.filter("seq % 11 = 0"))):  # then later records; then stale and repeated ones
        files.append_responses(part, log)
        advance()
    batch = evaluate.score(runs.last_records(files.read_log(spark, log).dropDuplicates(["model", "prompt", "run", "query_id", "seq"])), gold)
    names = ["model", "prompt", "run", "query_id", "seq", "tier1", "tier2", "tier3", "error"]
    got, want = (sorted(map(str, df.select(*names).collect())) for df in (live.corrected(spark, out), batch))
    assert got == want and sum("1000000" < str(r.seq) for r in live.corrected(spark, out).filter("seq >= 1000000").collect()) > 10


def test_only_changed_runs_are_scored_again(spark, tmp_path):
    gold = fixtures.gold(spark, SF).cache()
    rows = fixtures.responses(gold).filter("model = 'alpha' and prompt = 'few-shot'")
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    glob = f"{raw}/*/*/run_*/responses.jsonl"

    def put(run, text=None):
        folder = raw / "alpha" / "few-shot" / f"run_{run}"
        folder.mkdir(parents=True, exist_ok=True)
        lines = rows.filter(F.col("run") == run).toJSON().collect() if text is None else text
        (folder / "responses.jsonl").write_text("\n".join(lines) + "\n")
        return lines

    def check():
        got, want = (evaluate.aggregate(x).orderBy("model", "prompt").collect() for x in (incremental.scores(spark, store), evaluate.score(files.read_responses(spark, glob), gold)))
        for a, b in zip(got, want, strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == (pytest.approx(y) if isinstance(y, float) else y)

    put(1)
    lines = put(2)
    assert incremental.update(spark, glob, gold, store) == [("alpha", "few-shot", 1), ("alpha", "few-shot", 2)]
    check()
    assert incremental.update(spark, glob, gold, store) == []
    put(3)
    read = []
    plain = files.read_responses
    with mock.patch.object(incremental.files, "read_responses", lambda s, paths, *a: read.extend(paths) or plain(s, paths, *a)):
        assert incremental.update(spark, glob, gold, store) == [("alpha", "few-shot", 3)]
    assert len(read) == 1 and "run_3" in read[0]
    check()
    put(2, lines[: len(lines) // 2])
    (raw / "alpha" / "few-shot" / "run_1" / "responses.jsonl").unlink()
    assert incremental.update(spark, glob, gold, store) == [("alpha", "few-shot", 1), ("alpha", "few-shot", 2)]
    assert {r.run for r in incremental.scores(spark, store).select("run").distinct().collect()} == {2, 3}
    check()


def test_places_of_records_rise_along_a_file_of_many_blocks(spark, tmp_path):
    folder = tmp_path / "m" / "p" / "run_1"
    folder.mkdir(parents=True)
    (folder / "responses.jsonl").write_text("".join(json.dumps({"query_id": f"Q-{i:05d}", "raw_output": "x" * (i % 50)}) + "\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = files.read_responses(spark, f"{tmp_path}/*/*/run_*/responses.jsonl").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.query_id for r in rows] == [f"Q-{i:05d}" for i in range(3000)] and len({r.seq for r in rows}) == 3000 and rows[0].seq == 1


def test_tags_by_a_table_function(spark):
    register_tags(spark, "tags_of")
    texts = spark.createDataFrame([(1, "a [NAME] b"), (2, None), (3, "none"), (4, "[[DATE]] *** <PHONE>"), (5, "[NAME]" * 300)], "k int, t string")
    rows = spark.sql("select k, x.* from {texts}, lateral tags_of(t) x", texts=texts)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    want = texts.select("k", F.inline(find_tags(F.col("t")))).drop("pattern_no")
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) and rows.count() == 1 + 4 + 300
