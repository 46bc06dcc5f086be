"""The command line from annotated text to tables."""

import json

import pytest
from pyspark.sql import functions as F

from veilmark import cli
from veilmark.operators import report
from veilmark.sources import clients, files


def test_from_text_to_tables(spark, tmp_path):
    blocks = [f"===QUERY===\nPatient Customer#{i} came on 2024-01-{i:02d}\n===PHI_TAGS===\n" + json.dumps({"identifier_type": "NAME", "value": f"Customer#{i}"}) for i in range(10, 25)]
    (tmp_path / "q.txt").write_text("\n".join([*blocks, "===QUERY===\nwhat dose for asthma\n===PHI_TAGS===\n"]))
    prompts = {"_meta": {}, **{s: {"slug": s, "system_prompt": "s", "user_template": "Redact.\n\n{query}", "output_parser": "direct"} for s in ("a", "b")}}
    (tmp_path / "p.json").write_text(json.dumps(prompts))
    at = lambda x: str(tmp_path / x)
    cli.main(["split", "--source", at("q.txt"), "--output", at("gold")])
    for prompt in "ab":
        for _ in range(2):  # the second time nothing is left to do
            cli.main(["run", "--gold", at("gold"), "--prompts", at("p.json"), "--prompt", prompt, "--model", "m", "--output", at("log"), "--canary", "x"])
    cli.main(["score", "--gold", at("gold"), "--responses", at("log"), "--layout", "log", "--output", at("out")])
    assert spark.read.parquet(at("out/scores")).count() == 32
    cli.main(["analyse", "--output", at("out"), "--model", "m", "--contrast", "m/a,m/b", "--n-bootstrap", "20"])
    table = spark.read.csv(at("out/analysis/comparison_table"), header=True).collect()
    assert len(table) == 2 and all(float(r.t1_recall_mean) == 1 and float(r.t1_specificity_mean) == 1 for r in table)
    assert spark.read.csv(at("out/analysis/mcnemar"), header=True).first().p_value_corrected == "1.0"
    cli.main(["pilot", "--gold", at("gold"), "--responses", at("log"), "--output", at("out"), "--n-queries", "10"])
    assert spark.read.json(at("out/pilot")).count() == 2
    own = ["pilot", "--gold", at("gold"), "--output", at("own"), "--prompts", at("p.json"), "--prompt", "a", "--model", "m", "--n-queries", "10", "--n-runs", "3", "--log-file", at("pilot.txt")]
    for _ in range(2):  # the second time no call is left to make
        cli.main(own)
        row = spark.read.json(at("own/pilot")).first()
        assert (row.queries, row.runs, row.identical_rate, row.recommendation) == (8, 3, 1.0, "N=3")
    assert files.read_log(spark, at("own/pilot-log")).count() == 24 and "m / a: 100.0 % of 8 queries alike, N=3" in (tmp_path / "pilot.txt").read_text()


def test_the_whole_matrix_and_its_repair(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    (tmp_path / "q.txt").write_text("===QUERY===\nCustomer#7 came\n===PHI_TAGS===\n" + json.dumps({"identifier_type": "NAME", "value": "Customer#7"}))
    one = {"slug": "few-shot", "system_prompt": "s", "user_template": "Redact.\n\n{query}", "output_parser": "direct"}
    (tmp_path / "p.json").write_text(json.dumps({"a": one, "b": one | {"slug": "two-pass-llm"}}))
    (tmp_path / "m.json").write_text(json.dumps({"models": [{"slug": "x"}, {"slug": "y"}]}))
    (tmp_path / "i.json").write_text(json.dumps({"default": {"seed": 1}, "execution": {"runs_per_config": 2}, "canary": {"query": "Customer#1"}}))
    cli.main(["split", "--source", at("q.txt"), "--output", at("gold")])
    every = ["run", "--gold", at("gold"), "--prompts", at("p.json"), "--models", at("m.json"), "--params", at("i.json"), "--output", at("log"), "--all", "--log-file", at("run.txt")]
    cli.main(every)
    assert files.read_log(spark, at("log")).select("model", "prompt", "run").distinct().count() == 4
    cli.main([*every, "--include-ablations"])
    rows = files.read_log(spark, at("log"))
    assert rows.count() == 8 * 3 and rows.select("model", "prompt", "run").distinct().count() == 8
    assert "y / few-shot / run 2" in (tmp_path / "run.txt").read_text()
    broken = spark.createDataFrame([("P-1", "json_parse_failure", json.dumps({"text": "Customer#7", "type": "NAME"}))], "query_id string, error string, pass1_output string")
    gold = files.read_dataset(spark, at("gold")).first()
    broken = broken.withColumns({"query_id": F.lit(gold.query_id), "model": F.lit("x"), "prompt": F.lit("two-pass"), "run": F.lit(1), "seq": F.lit(0)})
    files.append_responses(broken, at("broken"))
    cli.main(["repair", "--gold", at("gold"), "--responses", at("broken"), "--output", at("mended")])
    row = files.read_log(spark, at("mended")).first()
    assert (row.raw_output, row.error, row.parse_status) == ("[NAME] came", None, "reprocessed_fixed")
    for wrong in (["repair", "--gold", at("gold"), "--responses", at("log"), "--output", at("log")], ["run", "--gold", "g", "--prompts", "p", "--output", "o", "--all"], ["pilot", "--gold", "g", "--output", "o"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)
    assert clients.unload("http://127.0.0.1:9", "m", 0.2) is False


def test_the_best_value_is_bold(spark):
    rows = spark.createDataFrame([("a", 0.5, 9.0), ("b", 0.9, 3.0), ("c", 0.9, None)], "name string, recall double, ms double")
    text = report.latex_table(rows, "t", 1, {"recall": "max", "ms": "min"})
    assert r"b & \textbf{0.9} & \textbf{3.0}" in text and text.count("textbf") == 2
