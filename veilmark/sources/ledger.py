"""A ledger of model calls: each reply is on disk before anything reads it.

A call is known by (model, prompt, run, query_id, pass) and a hash of what was asked. Calls that the ledger
has are never made again, so a run that was stopped, or whose later steps failed, goes on where it was. They
are made in waves, each a job of its own: what an interruption can lose is the wave in flight.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clients

KEYS = ["model", "prompt", "run", "query_id", "pass"]
CALL = f"model string, prompt string, run int, query_id string, pass int, asked string, called_at timestamp, {clients.REPLY}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Ledger:
    """The calls recorded below ``path``, a folder that driver and executors share.

    ``wave``: calls in one job at most. ``at_once``: calls that run at the same time at most (None: as many
    as the cluster has cores). With ``retry_errors`` a call that ended in an error counts as not made; its
    next reply stands in its place.
    """

    def __init__(self, spark: SparkSession, path: str, wave: int = 2000, at_once: int | None = None, retry_errors: bool = False):
        if spark.conf.get("spark.speculation", "false") == "true":
            raise ValueError("spark.speculation would make calls twice")
        self.spark, self.path, self.wave, self.retry_errors = spark, path.rstrip("/"), wave, retry_errors
        self.at_once = at_once or spark.sparkContext.defaultParallelism

    def rows(self) -> DataFrame:
        """One row for each call: the first reply without an error, else the first."""
        try:
            every = self.spark.read.schema(CALL).parquet(f"{self.path}/calls")
        except AnalysisException as e:  # no call yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], CALL)
        values = [f.name for f in every.schema if f.name not in (*KEYS, "asked")]
        best = F.min_by(F.struct(*values), F.struct(F.col("error").isNotNull(), "called_at"))
        return every.groupBy(*KEYS, "asked").agg(best.alias("_reply")).select(*KEYS, "asked", "_reply.*")

    def ask(self, prompts: DataFrame, number: int, client: clients.Client, params: dict | None = None, only: str | None = None) -> DataFrame:
        """``prompts`` (model, prompt, run, query_id, system, user and more) with the reply's columns, as ``clients.ask``.

        The calls of pass ``number`` that the ledger lacks are made first, once for each key; rows that agree in the
        key and in what they ask share one reply. Null keys are keys like others. ``only``: see ``clients.ask``.
        """
        asked = F.sha2(F.concat_ws("|||", "system", "user"), 256)
        keyed = prompts.withColumns({"pass": F.lit(number), "asked": asked})
        wanted = keyed.filter(F.col(only)) if only else keyed
        self._make(wanted.select(*KEYS, "asked", "system", "user"), client, params)
        on = [keyed[c].eqNullSafe(F.col(f"_l.{c}")) for c in (*KEYS, "asked")]
        reply = self.rows().drop("called_at").alias("_l")
        names = [c.split()[0] for c in clients.REPLY.split(", ")]
        if only:
            on = [F.col(only), *on]
        return keyed.join(reply, on, "left").select(*[keyed[c] for c in prompts.columns], *[F.col(f"_l.{c}") for c in names])

    def _make(self, keyed: DataFrame, client: clients.Client, params: dict | None) -> None:
        done = self.rows().filter("error is null") if self.retry_errors else self.rows()
        on = [keyed[c].eqNullSafe(F.col(f"_d.{c}")) for c in (*KEYS, "asked")]
        missing = keyed.join(done.select(*KEYS, "asked").alias("_d"), on, "left_anti").dropDuplicates([*KEYS, "asked"])
        # what is to be asked is fixed before the first call: the waves read it, not the plan behind it
        todo = f"{self.path}/_todo-{uuid.uuid4().hex}"
        missing.write.parquet(todo)
        try:
            fixed = self.spark.read.schema(missing.schema).parquet(todo)
            waves = -(-fixed.count() // self.wave)
            at = F.pmod(F.xxhash64("query_id", "asked"), F.lit(max(waves, 1)))
            for k in range(waves):
                mine = fixed.filter(at == k).repartition(self.at_once)
                replies = clients.ask(mine, client, params).withColumn("called_at", F.current_timestamp())
                replies.drop("system", "user").write.mode("append").parquet(f"{self.path}/calls")
        finally:
            remove(self.spark, todo)
