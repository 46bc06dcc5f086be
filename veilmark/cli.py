"""Command line: python -m veilmark.cli COMMAND --help."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maps
from .functions.text import filled
from .operators import analysis, evaluate, runs
from .sources import clients, files
from .sources.ledger import Ledger

log = logging.getLogger("veilmark")


def set_up_logging(path: str | None = None, level: int = logging.INFO) -> None:
    """Log of the driver to standard output, and to a file if one is named."""
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if path:
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers, log.propagate = handlers, False
    log.setLevel(level)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    gold = files.read_delimited(spark, a.source)
    files.write_dataset(gold, a.output)
    files.type_distribution(gold).show(truncate=False)
    files.complexity_histogram(gold).show()


def _run_one(spark: SparkSession, a: argparse.Namespace, gold: DataFrame, model: str, prompt: dict, number: int, client: clients.Client, params: dict, canary: str | None) -> None:
    """Append the answers that one (model, prompt, run) still lacks."""
    log.info("%s / %s / run %d", model, prompt["slug"], number)
    try:
        done = files.read_log(spark, a.output).select("model", "prompt", "run", "query_id", "seq")
        start = done.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
    except AnalysisException as e:  # no log yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done, start = None, 0
    # what was asked before a stop is in the ledger: only missing calls are made
    book = Ledger(spark, getattr(a, "ledger", None) or f"{a.output.rstrip('/')}-calls")
    rows = clients.run_log(gold, done, model, prompt, number, client, params, canary, book)
    files.append_responses(rows.withColumn("seq", F.monotonically_increasing_id() + start), a.output)


def _client(a: argparse.Namespace, tag: str) -> clients.Client:
    return clients.retrying(clients.http_client(a.host, tag, a.timeout)) if a.host else clients.rule_client


def _asked(gold: DataFrame, prompt: dict) -> DataFrame:
    """(system, user) of a prompt's first pass for each query."""
    template = prompt.get("user_template") or prompt.get("pass1_user_template")
    return gold.select(F.lit(prompt.get("system_prompt", "")).alias("system"), filled(F.lit(template), F.col("query_text")).alias("user"))


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """One (model, prompt, run), or with --all every model with every prompt and run of the configuration.

    The configurations are few and go one after another, as a server holds one model; the queries of each
    are distributed. Without --include-ablations --all takes the primary prompts only.
    """
    gold = files.read_dataset(spark, a.gold)
    prompts = [v for k, v in files.read_config(spark, a.prompts).items() if not k.startswith("_")]
    models = files.read_config(spark, a.models)["models"] if a.models else [{"slug": a.model}]
    config = files.read_config(spark, a.params) if a.params else {}
    execution, canary = config.get("execution", {}), a.canary or config.get("canary", {}).get("query")
    if a.all:
        prompts = [p for p in prompts if a.include_ablations or p["slug"] in maps.PRIMARY_PROMPTS]
        numbers = range(1, execution.get("runs_per_config", 3) + 1)
    else:
        prompts, models, numbers = [files.by_slug(prompts, a.prompt)], [files.by_slug(models, a.model)], [a.run]
    for model in models:
        tag, pause = model.get(maps.MODEL_TAG, model["slug"]), execution.get("cooldown_between_models_seconds", 0)
        client = _client(a, tag)
        for prompt in prompts:
            params = files.parameters(config.get("default", {}), config.get("model_overrides", {}).get(model["slug"]), prompt.get("parameters"))
            if a.all and a.host:
                clients.warm_up(client, _asked(gold, prompt), execution.get("warmup_queries", 10), params)
            for number in numbers:
                _run_one(spark, a, gold, model["slug"], prompt, number, client, params, canary)
            if a.all and a.host:
                clients.unload(a.host, tag)
        if a.all and a.host:
            time.sleep(pause)


def repair(spark: SparkSession, a: argparse.Namespace) -> None:
    """A new version of a log, with the two-pass records repaired whose list could not be read at first."""
    if a.output.rstrip("/") == a.responses.rstrip("/"):
        raise SystemExit("--output must be another path than --responses: a log is never written over")
    fixed = runs.repair_two_pass(files.read_log(spark, a.responses), files.read_dataset(spark, a.gold), a.whole_prompt)
    files.append_responses(fixed.drop("position", "repair"), a.output)
    runs.repair_counts(fixed).orderBy(*runs.LOG).show(truncate=False)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    responses = files.read_responses(spark, a.responses) if a.layout == "files" else files.read_log(spark, a.responses)
    for column in ("model", "prompt"):
        if getattr(a, column) and not a.all:
            responses = responses.filter(F.col(column) == getattr(a, column))
    files.write_scores(evaluate.score(responses, files.read_dataset(spark, a.gold)), f"{a.output}/scores")
    scores = spark.read.parquet(f"{a.output}/scores")
    files.write_json(evaluate.as_documents(evaluate.aggregate(scores), evaluate.by_category(scores)), f"{a.output}/evaluation")


def analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    scores = spark.read.parquet(f"{a.output}/scores")
    contrasts = spark.createDataFrame([(f"{x} vs {y}", x, y) for x, y in (c.split(",") for c in a.contrast)], "comparison string, a string, b string")
    for name, table in analysis.analyse(scores, analysis.families(scores, a.prompt, a.model), contrasts, a.n_bootstrap, a.draws).items():
        files.write_csv(table, f"{a.output}/analysis/{name}")


def pilot(spark: SparkSession, a: argparse.Namespace) -> None:
    """How alike repeated runs over a sample are: those of a log (--responses), or --n-runs made here with one prompt."""
    gold = files.read_dataset(spark, a.gold)
    sample = gold.join(runs.stratified_sample(gold, a.n_queries).select("query_id"), "query_id")
    log_at = a.responses or f"{a.output}/pilot-log"
    if not a.responses:
        prompts = [v for k, v in files.read_config(spark, a.prompts).items() if not k.startswith("_")]
        models = files.read_config(spark, a.models)["models"] if a.models else [{"slug": a.model}]
        prompt, model = files.by_slug(prompts, a.prompt), files.by_slug(models, a.model)
        params = files.read_config(spark, a.params).get("default", {}) if a.params else {}
        client = _client(a, model.get(maps.MODEL_TAG, model["slug"]))
        if a.host:
            clients.warm_up(client, _asked(sample, prompt), 10, params)
        for number in range(1, a.n_runs + 1):
            _run_one(spark, argparse.Namespace(output=log_at), sample, model["slug"], prompt, number, client, params, None)
    responses = files.read_log(spark, log_at).join(sample.select("query_id"), "query_id")
    found = runs.pilot(responses, gold)
    files.write_json(found, f"{a.output}/pilot")
    for row in found.collect():  # one for each configuration
        log.info("%s / %s: %.1f %% of %d queries alike, %s", row["model"], row["prompt"], 100 * row["identical_rate"], row["queries"], row["recommendation"])


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="veilmark")
    commands = out.add_subparsers(required=True)

    def command(name, run_, *options):
        p = commands.add_parser(name)
        p.set_defaults(call=run_)
        for flags, about in options:
            p.add_argument(flags, **about)

    gold, output, responses = ("--gold", {"required": True}), ("--output", {"required": True}), ("--responses", {"required": True})
    yes, log_file = {"action": "store_true"}, ("--log-file", {})
    command("split", split, ("--source", {"required": True}), output, log_file)
    command(
        "run", run, gold, output, log_file, ("--prompts", {"required": True}), ("--prompt", {}), ("--model", {}), ("--run", {"type": int, "default": 1}), ("--all", yes), ("--include-ablations", yes),
        ("--models", {}), ("--params", {}), ("--host", {}), ("--timeout", {"type": float, "default": 120}), ("--canary", {}), ("--ledger", {}),
    )
    command("repair", repair, gold, responses, output, log_file, ("--whole-prompt", yes))
    command("score", score, gold, responses, output, log_file, ("--layout", {"choices": ("files", "log"), "default": "files"}), ("--model", {}), ("--prompt", {}), ("--all", yes))
    command("analyse", analyse, output, log_file, ("--prompt", {}), ("--model", {}), ("--contrast", {"action": "append", "default": []}), ("--n-bootstrap", {"type": int, "default": 10_000}), ("--draws", {"choices": ("numpy", "poisson"), "default": "numpy"}))
    command(
        "pilot", pilot, gold, output, log_file, ("--responses", {}), ("--n-queries", {"type": int, "default": 100}), ("--n-runs", {"type": int, "default": 10}), ("--prompts", {}), ("--prompt", {"default": "zero-shot-structured"}),
        ("--model", {"default": "phi4-mini"}), ("--models", {}), ("--params", {}), ("--host", {}), ("--timeout", {"type": float, "default": 120}),
    )
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.call is run and not (a.models if a.all else a.model and a.prompt):
        raise SystemExit("run takes --model and --prompt, or --all and --models")
    if a.call is pilot and not (a.responses or a.prompts):
        raise SystemExit("pilot takes --responses, or --prompts to make the runs itself")
    set_up_logging(getattr(a, "log_file", None))
    a.call(SparkSession.builder.appName("veilmark").getOrCreate(), a)


if __name__ == "__main__":
    main()
