"""Calls are made once: by one action without a ledger, by any number of runs with one."""

import json
import os
from collections import Counter
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from veilmark.sources import clients, files, ledger

ONE = {"slug": "p", "system_prompt": "s", "user_template": "Redact.\n\n{query}", "output_parser": "direct"}
TWO = {
    "slug": "t", "system_prompt": "list as JSON", "pass1_user_template": "Find.\n\nText: {query}", "output_parser": "json_then_llm_replace",
    "pass2_system_prompt": "s", "pass2_user_template": "{phi_json}\n\n{query}",
}


@pytest.fixture
def gold(spark):
    return spark.createDataFrame([(f"Q-{i:02d}", f"Customer#{i} came") for i in range(10)], "query_id string, query_text string")


class Recorded:
    """A client that notes each call in a file; ``trouble`` (number of the call) says what goes wrong."""

    def __init__(self, path, trouble=lambda k: None):
        self.path, self.trouble = str(path), trouble

    def __call__(self, system, user, params):
        with open(self.path, "a") as f:
            f.write(json.dumps([system, user]) + "\n")
        with open(self.path) as f:
            k = len(f.readlines())
        match self.trouble(k):
            case "reply":
                return clients.Reply(error="timeout_1s", latency_ms=5)
            case "raise":
                raise RuntimeError("no answer")
            case "kill":
                os._exit(1)
        return clients.rule_client(system, user, params)

    def calls(self):
        with open(self.path) as f:
            return Counter(tuple(json.loads(x)) for x in f)


def by_pass(calls):
    return Counter(1 if system == TWO["system_prompt"] else 2 for system, _ in calls.elements())


def test_one_action_makes_each_call_once(spark, gold, tmp_path):
    client = Recorded(tmp_path / "calls")
    rows = clients.run_log(gold, None, "m", TWO, 1, client).collect()
    assert by_pass(client.calls()) == {1: 10, 2: 10} and set(client.calls().values()) == {1}
    assert {r.query_id: r.raw_output for r in rows} == {f"Q-{i:02d}": "[NAME] came" for i in range(10)}
    assert all(r.pass2_method == "llm" and r.error is None and r.latency_ms == 2 and r.pass2_latency_ms == 1 for r in rows)


def test_any_number_of_actions_read_the_ledger(spark, gold, tmp_path):
    client, book = Recorded(tmp_path / "calls"), ledger.Ledger(spark, str(tmp_path / "ledger"), wave=4)
    first = clients.run_log(gold, None, "m", TWO, 1, client, ledger=book)
    plain = clients.run_log(gold, None, "m", TWO, 1, clients.rule_client)
    assert sorted(first.columns) == sorted(plain.columns)
    assert sorted(map(str, first.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert first.count() == 10 and by_pass(client.calls()) == {1: 10, 2: 10}
    assert clients.run_log(gold, None, "m", TWO, 1, client, ledger=ledger.Ledger(spark, str(tmp_path / "ledger"))).count() == 10
    assert by_pass(client.calls()) == {1: 10, 2: 10}
    clients.run_log(gold, None, "m", TWO, 2, client, ledger=book)  # another run is asked anew
    assert by_pass(client.calls()) == {1: 20, 2: 20}
    clients.run_log(gold, None, "m", TWO | {"system_prompt": "list as JSON"[:-1] + "N"}, 1, client, ledger=book)
    assert book.rows().count() == 40 and not [x for x in os.listdir(tmp_path / "ledger") if x.startswith("_todo")]
    clients.run_log(gold, None, "m", TWO | {"pass1_user_template": "Look.\n\nText: {query}"}, 1, client, ledger=book)  # another question
    assert book.rows().filter("pass = 1").count() == 30


@pytest.mark.parametrize("kind", ["reply", "raise"])
@pytest.mark.parametrize("prompt", [ONE, TWO])
def test_every_other_call_fails(spark, gold, tmp_path, kind, prompt):
    client, book = Recorded(tmp_path / "calls", lambda k: kind if k % 2 else None), ledger.Ledger(spark, str(tmp_path / "ledger"), wave=3, at_once=1)
    rows = clients.run_log(gold, None, "m", prompt, 1, client, canary="Customer#1", ledger=book)
    got = {r.query_id: r for r in rows.collect()}
    assert rows.count() == len(got) == 12 and client.calls()["s" if prompt is ONE else prompt["system_prompt"], ("Redact.\n\n" if prompt is ONE else "Find.\n\nText: ") + "Customer#1"] == 2  # both canaries
    failed = [r for r in got.values() if r.error is not None]
    assert len(failed) >= 6 and all(r.raw_output is None and r.error in ("timeout_1s", "unexpected_error: no answer") for r in failed)
    again = ledger.Ledger(spark, str(tmp_path / "ledger"), retry_errors=True)
    mended = clients.run_log(gold, None, "m", prompt, 1, clients.rule_client, canary="Customer#1", ledger=again)
    assert mended.count() == 12 and mended.filter("error is not null or raw_output not like '[NAME]%'").count() == 0


def test_killed_and_resumed(spark, gold, tmp_path):
    client, path = Recorded(tmp_path / "calls", lambda k: "kill" if k == 9 else None), str(tmp_path / "ledger")
    with pytest.raises(Exception, match="crash|exited|EOF|Python worker"):
        clients.run_log(gold, None, "m", ONE, 1, client, ledger=ledger.Ledger(spark, path, wave=2, at_once=1))
    kept = ledger.Ledger(spark, path).rows()
    saved = {r.query_id for r in kept.collect()}
    assert 3 <= len(saved) < 10
    before = client.calls()
    rows = clients.run_log(gold, None, "m", ONE, 1, client, ledger=ledger.Ledger(spark, path))
    assert {r.query_id: r.raw_output for r in rows.collect()} == {f"Q-{i:02d}": "[NAME] came" for i in range(10)}
    fresh = client.calls() - before
    assert sum(fresh.values()) == 10 - len(saved) and not {f"Customer#{int(q[2:])} came" for q in saved} & {u.rsplit("\n\n", 1)[-1] for _, u in fresh}


def test_rows_of_one_key_and_null_keys(spark, tmp_path):
    client, book = Recorded(tmp_path / "calls"), ledger.Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("m", "p", 1, q, "s", "a") for q in ("x", "x", None)], "model string, prompt string, run int, query_id string, system string, user string")
    assert book.ask(rows, 1, client).filter("raw_output = 'a'").count() == 3 and sum(client.calls().values()) == 2
    assert book.ask(rows.limit(0), 1, client).count() == 0 and book.ask(rows.withColumn("system", F.lit(None).cast("string")), 1, client).count() == 3


def test_speculation_is_refused(tmp_path):
    session = MagicMock()
    session.conf.get.return_value = "true"
    with pytest.raises(ValueError, match="speculation"):
        ledger.Ledger(session, str(tmp_path))


def test_log_from_a_ledger(spark, gold, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    rows = clients.run_log(gold, None, "m", ONE, 1, clients.rule_client, ledger=book)
    files.append_responses(rows.withColumn("seq", F.monotonically_increasing_id()), str(tmp_path / "log"))
    done = files.read_log(spark, str(tmp_path / "log"))
    assert done.count() == 10 and clients.run_log(gold, done, "m", ONE, 1, clients.rule_client, ledger=book).count() == 0
