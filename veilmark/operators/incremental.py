"""Evaluation of growing logs: only runs whose files changed are read and scored again.

Logs are laid out as model/prompt/run_n/*.jsonl. A manifest keeps path, size and time of each file that the stored
scores come from; scores are stored by run, and rates are worked out from the stored scores, whose texts are
not needed any more. Scores are written before the manifest: what is interrupted is done again, never left out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.ledger import remove
from . import evaluate

RUN = ["model", "prompt", "run"]
MANIFEST = "path string, length bigint, modified timestamp, model string, prompt string, run int"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, model, prompt, run) of the files of a glob, without reading them."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return rows.select("*", *[c.alias(n) for n, c in zip(RUN, files.run_of(F.col("path")))])


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def changed_runs(now: DataFrame, known: DataFrame) -> DataFrame:
    """(model, prompt, run) with a file that is new, gone, or of another size or time."""
    both = now.alias("a").join(known.alias("b"), "path", "full_outer")
    other = ~F.col("a.length").eqNullSafe(F.col("b.length")) | ~F.col("a.modified").eqNullSafe(F.col("b.modified"))
    return both.filter(other).select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in RUN]).distinct()


def update(spark: SparkSession, responses: str, gold: DataFrame, store: str) -> list[tuple[str, str, int]]:
    """Bring the scores below ``store`` up to date with the logs that the glob ``responses`` names; the runs that were
    scored, or dropped because their files are gone.

    Paths of changed files, a few for each run, go by way of the driver. The gold set is taken as it was: scores by another
    one go to another store.
    """
    now = listing(spark, responses)
    known = spark.createDataFrame(_read(spark, f"{store}/manifest", MANIFEST).collect(), MANIFEST)  # written over below
    runs = changed_runs(now, known)
    paths = [r.path for r in now.join(runs, RUN, "left_semi").select("path").collect()]
    done = [tuple(r) for r in runs.collect()]
    if not done:
        return []
    manifest = now.collect()  # what the scores below are of, whatever comes in meanwhile
    there = {(r["model"], r["prompt"], r["run"]) for r in manifest}
    if paths:
        scores = evaluate.score(files.read_responses(spark, paths), gold)
        scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).parquet(f"{store}/scores")
    for model, prompt, run in set(done) - there:
        remove(spark, f"{store}/scores/model={model}/prompt={prompt}/run={run}")
    spark.createDataFrame([tuple(r) for r in manifest], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest")
    return sorted(done)


def scores(spark: SparkSession, store: str) -> DataFrame:
    """The stored scores; filters on model, prompt and run read only those folders."""
    return spark.read.parquet(f"{store}/scores").withColumns({"model": F.col("model").cast("string"), "prompt": F.col("prompt").cast("string")})
