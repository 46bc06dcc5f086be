"""Redaction systems as sources of responses.

A client is a function of (system prompt, user prompt, parameters) that returns a ``Reply``; batches of
prompts go through it in ``mapInPandas``, so calls run on all executors at once. Two clients are at hand:
a rule-based stand-in that needs no network, and one for chat servers that answer JSON over HTTP.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonitems import json_items
from ..functions.text import direct_answer, filled, redact

REPLY = "raw_output string, error string, latency_ms bigint, tokens_input bigint, tokens_output bigint, output_truncated boolean, context_exceeded boolean"


@dataclass
class Reply:
    raw_output: str | None = None
    error: str | None = None
    latency_ms: int = -1
    tokens_input: int = 0
    tokens_output: int = 0
    output_truncated: bool = False
    context_exceeded: bool = False


Client = Callable[[str, str, dict], Reply]

#: What the stand-in looks for: (type, pattern).
RULES = (
    ("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.]+"),
    ("PHONE", r"\+?\d?[ -]?\(?\d{3}\)?[ -.]\d{3}[ -.]\d{4}"),
    ("DATE", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("MRN", r"(?<=MRN )\d+"),
    ("NAME", r"\bCustomer#\d+\b"),
)


def rule_client(system: str, user: str, params: dict) -> Reply:
    """Redacts the last paragraph of a prompt by rules; asked for JSON, it lists what it finds."""
    text = user.rsplit("\n\n", 1)[-1].removeprefix("Text: ")
    found = [(kind, m[0]) for kind, rx in RULES for m in re.finditer(rx, text)]
    if "JSON" in system or "JSON" in user:
        return Reply("\n".join(json.dumps({"text": v, "type": k}) for k, v in found) or "[]", None, 1, len(user.split()), len(found))
    for kind, value in sorted(found, key=lambda x: -len(x[1])):
        text = text.replace(value, f"[{kind}]")
    return Reply(text, None, 1, len(user.split()), len(text.split()))


def http_client(url: str, model: str, timeout: float = 120) -> Client:
    """A client of a chat server (POST {url}/api/chat, one message each way, not streamed)."""

    def call(system: str, user: str, params: dict) -> Reply:
        names = ("temperature", "top_k", "seed", "num_predict", "num_ctx", "presence_penalty")
        body = {"model": model, "stream": False, "options": {k: params[k] for k in names if k in params}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        began = time.time()
        try:
            request = urllib.request.Request(f"{url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                got = json.load(answer)
        except TimeoutError:
            return Reply(error=f"timeout_{timeout:g}s", latency_ms=int((time.time() - began) * 1000))
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                return Reply(error=f"timeout_{timeout:g}s", latency_ms=int((time.time() - began) * 1000))
            return Reply(error=f"connection_error: {e.reason}")
        except (OSError, ValueError) as e:
            return Reply(error=f"unexpected_error: {e}")
        took, n_in, n_out = int((time.time() - began) * 1000), got.get("prompt_eval_count", 0), got.get("eval_count", 0)
        return Reply(
            got.get("message", {}).get("content", ""), None, took, n_in, n_out,
            n_out >= params.get("num_predict", 1 << 62) - 1, n_in + params.get("num_predict", 0) > params.get("num_ctx", 1 << 62),
        )

    return call


def unload(url: str, model: str, timeout: float = 30) -> bool:
    """Ask a chat server to drop a model from memory; whether it answered. A server that does not is no error."""
    body = json.dumps({"model": model, "keep_alive": 0}).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"{url}/api/generate", body, {"Content-Type": "application/json"}), timeout=timeout):
            return True
    except (OSError, ValueError):
        return False


def retrying(client: Client, retries: int = 2, pause: float = 2.0) -> Client:
    """Up to ``retries`` more calls after an error, with growing pauses; the last reply counts."""

    def call(system: str, user: str, params: dict) -> Reply:
        for attempt in range(retries + 1):
            reply = client(system, user, params)
            if reply.error is None or attempt == retries:
                break
            time.sleep(pause * (attempt + 1))
        return reply

    return call


def warm_up(client: Client, prompts: DataFrame, n: int = 10, params: dict | None = None) -> int:
    """Send the first ``n`` prompts and drop the replies; how many were answered."""
    return sum(client(r["system"], r["user"], params or {}).error is None for r in prompts.select("system", "user").limit(n).collect())


def _answered(client: Client, system: str, user: str, params: dict) -> dict:
    """A reply whatever happens: what a client raises becomes its reply's error."""
    try:
        return asdict(client(system, user, params))
    except Exception as e:  # one query's trouble is no reason to lose the others' replies
        return asdict(Reply(error=f"unexpected_error: {e}"))


def ask(prompts: DataFrame, client: Client, params: dict | None = None, system: str = "system", user: str = "user", only: str | None = None) -> DataFrame:
    """``prompts`` with the reply's columns; one call for each row, or each for which the column ``only`` is true (the
    others have a reply of nulls). Each action on the result makes the calls: where a reply is to be read more
    than once a ``ledger.Ledger`` keeps it."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    names = [c.split()[0] for c in REPLY.split(", ")]

    def run(batches):
        for rows in batches:
            wanted = rows[only] if only else [True] * len(rows)
            replies = [_answered(client, s, u, params or {}) if w else {} for w, s, u in zip(wanted, rows[system], rows[user])]
            made = pd.DataFrame(replies, columns=names, dtype=object)
            yield pd.concat([rows.reset_index(drop=True), made], axis=1)

    return prompts.mapInPandas(run, f"{kept}, {REPLY}")


def respond(todo: DataFrame, prompt: dict, client: Client, params: dict | None = None, ledger=None) -> DataFrame:
    """Responses of one prompt to queries (query_id, query_text): by its parser in one or two passes.

    direct: the answer without its prefixes. json_then_replace: the listed items are replaced in the
    query. json_then_llm_replace: the list goes into a second prompt. A list that cannot be read is the
    error json_parse_failure. Both passes are steps of one plan, so that an action makes each call once.
    With a ``ledger`` (then ``todo`` has model, prompt and run, too) calls are made here and now, those that
    it has are not made again, and any number of actions read the same replies.
    """
    parser = prompt.get("output_parser", "direct")
    template = prompt.get("user_template") or prompt.get("pass1_user_template")
    if template is None:
        raise ValueError("a prompt needs user_template or pass1_user_template")
    rows = todo.withColumn("system", F.lit(prompt.get("system_prompt", ""))).withColumn("user", filled(F.lit(template), F.col("query_text")))
    rows = rows.withColumn("input_text", F.concat(F.lit("[SYSTEM] "), "system", F.lit("\n[USER] "), "user"))
    first = ledger.ask(rows, 1, client, params) if ledger else ask(rows, client, params)
    if parser == "direct":
        answer = F.when(F.col("error").isNull(), direct_answer(F.col("raw_output")))
        return first.withColumn("raw_output", answer).drop("system", "user", "context_exceeded")
    first = first.withColumnsRenamed({"raw_output": "pass1_output", "latency_ms": "pass1_latency_ms"}).drop("system", "user", "output_truncated", "context_exceeded")
    first = first.withColumn("_items", F.when(F.col("error").isNull(), json_items(F.col("pass1_output"))))
    unread = F.col("error").isNull() & F.col("_items").isNull()
    called = F.col("error").isNull()
    first = first.withColumns({"pass2_method": F.when(called, "programmatic" if parser == "json_then_replace" else "llm"), "error": F.when(unread, "json_parse_failure").otherwise(F.col("error"))})
    if parser == "json_then_replace":
        text = redact(F.col("query_text"), F.col("_items"))
        return first.withColumns({"raw_output": text, "pass2_output": text, "latency_ms": F.col("pass1_latency_ms")}).drop("_items")
    listed = F.array_join(F.transform("_items", lambda x: F.to_json(x)), "\n")
    second = first.withColumns({"_fine": F.col("error").isNull(), "system": F.lit(prompt.get("pass2_system_prompt", "")), "user": filled(F.lit(prompt.get("pass2_user_template", "")), F.col("query_text"), listed)})
    second = second.drop("_items").withColumnsRenamed({"tokens_output": "_tokens1", "tokens_input": "_tokens0", "error": "_error1"})
    asked = ledger.ask(second, 2, client, params, only="_fine") if ledger else ask(second, client, params, only="_fine")
    fine = F.col("_fine")
    return asked.withColumns(
        {
            "pass2_output": F.col("raw_output"), "pass2_latency_ms": F.when(fine, F.col("latency_ms")),
            "raw_output": direct_answer(F.nullif("raw_output", F.lit(""))), "latency_ms": F.col("pass1_latency_ms") + F.when(fine, F.col("latency_ms")).otherwise(0),
            "tokens_output": F.when(fine, F.col("_tokens1") + F.col("tokens_output")).otherwise(F.col("_tokens1")), "tokens_input": F.col("_tokens0"),
            "error": F.coalesce("_error1", "error"),
        }
    ).drop("system", "user", "_fine", "_tokens0", "_tokens1", "_error1", "output_truncated", "context_exceeded")


def run_log(gold: DataFrame, done: DataFrame | None, model: str, prompt: dict, run: int, client: Client, params: dict | None = None, canary: str | None = None, ledger=None) -> DataFrame:
    """Responses of one (model, prompt, run) to the queries that ``done`` has none for, the canary first and last.
    ``ledger``: see ``respond``."""
    todo = gold.select("query_id", "query_text").withColumns({"is_canary": F.lit(False), "canary_position": F.lit(None).cast("int")})
    if canary is not None:
        ends = gold.sparkSession.createDataFrame([("canary_start", canary, True, 0), ("canary_end", canary, True, 1052)], todo.schema)
        todo = todo.unionByName(ends)
    if done is not None:
        mine = done.filter((F.col("model") == model) & (F.col("prompt") == prompt["slug"]) & (F.col("run") == run))
        todo = todo.join(mine.select("query_id"), "query_id", "left_anti")
    about = {"model": F.lit(model), "prompt": F.lit(prompt["slug"]), "run": F.lit(run), "model_name": F.lit(model), "prompt_style": F.lit(prompt["slug"]), "run_number": F.lit(run)}
    todo = todo.withColumns(about)
    return respond(todo, prompt, client, params, ledger).drop("query_text")
