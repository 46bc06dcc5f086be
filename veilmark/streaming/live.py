"""Scores of a growing response log as a stream.

Two views. ``live_scores``: scoring a response needs nothing but its query, so it keeps no state but what drops
repeated records, bounded by a watermark; of a query the first record counts. ``corrections``: for each
query the stream keeps the record of the highest ``seq`` and gives its score again when a later one comes, so
that the last record wins, as in the batch view over the log, however late or often records come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.evaluate import score


def response_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """New records of a log that is partitioned by model, prompt and run."""
    schema = f"{schemas.RESPONSE}, seq bigint, model string, prompt string, run int"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def live_scores(responses: DataFrame, gold: DataFrame, late: str = "1 hour") -> DataFrame:
    """Scores of each first record, repeated ones within ``late`` of another dropped."""
    timed = responses.withColumn("_time", F.coalesce(F.try_to_timestamp("timestamp_utc"), F.current_timestamp())).withWatermark("_time", late)
    first = timed.dropDuplicatesWithinWatermark(["model", "prompt", "run", "query_id"])
    return score(first, gold)


def start(scores: DataFrame, sink: str, checkpoint: str, **trigger):
    """Append scores to Parquet; the checkpoint makes each record count once."""
    writer = scores.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).partitionBy("model", "prompt")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


KEYS = ["model", "prompt", "run", "query_id"]


def corrections(responses: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores of the last record so far of each query, given again whenever records of the query come in.

    The state is one record for each query of the logs, in the state store of the task that has the query. To be written in
    update mode, by ``start_corrections``.
    """
    fields = [c for c in responses.columns if c not in KEYS]
    last = responses.groupBy(*KEYS).agg(F.max_by(F.struct(*fields), "seq").alias("_last")).select(*KEYS, "_last.*")
    return score(last, gold)


def start_corrections(scores: DataFrame, sink: str, checkpoint: str, **trigger):
    """Write each batch of ``corrections`` to a folder of its own below ``sink``: one that is run again writes the same folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = scores.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def corrected(spark: SparkSession, sink: str) -> DataFrame:
    """What counts of the scores below ``sink``: of each query that of the highest seq, the latest batch's of equal ones."""
    rows = spark.read.parquet(sink)
    fields = [c for c in rows.columns if c not in KEYS]
    best = F.max_by(F.struct(*fields), F.struct("seq", "batch"))
    return rows.groupBy(*KEYS).agg(best.alias("_last")).select(*KEYS, "_last.*").drop("batch")
