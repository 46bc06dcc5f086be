"""Helpers shared by the training-data operators: shared scratch folders, byte access to text
columns, whitespace and alphanumeric words, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

#: bytes.translate table: A-Z lower-cased; every ASCII byte that is no letter or digit becomes a space.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where that setting is absent (tests, one machine) a temporary folder is made for the session, which
    goes when the driver ends; on a cluster the setting is required.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("veilmark.scratch.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="veilmark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set("veilmark.scratch.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, and survives
    the loss of any executor."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind ``written`` frames that nothing will read any more."""
    jvm = spark._jvm
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that goes by a shuffle: a table that grows with the corpus is not sent whole through the
    driver, however small the planner takes it for."""
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs: it learns of them by garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows that a batch of texts in Python holds at most.
BATCH = 1_000


@contextmanager
def small_batches(spark: SparkSession):
    """While an action runs inside, batches of ``BATCH`` rows go to Python, unless the session's own limit is not Spark's
    default; then the setting is what it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if was == "10000":
        spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def map_texts(rows: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for rows that hold whole texts: batches are handed on in slices of ``BATCH`` rows, whatever the
    session's own limits for them are, and memory that a worker no longer needs is given back."""

    def frugal(batches):
        yield from run(b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH))
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return rows.mapInArrow(frugal, schema)


#: Bytes that a partition, or a file, is planned for.
PIECE = 256 << 20


def partitions_for(df: DataFrame) -> int:
    """Partitions to deal ``df`` to: as many as shuffles have, and more if the planner's estimate of its size asks for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PIECE), 1_000_000))


def utf8(column: pa.Array) -> list:
    """The rows of a string column as bytes (None where null), without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters; null has none."""
    return text.translate(ALNUM_TABLE).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space; null has none."""
    return text.split() if text else []


def columns(df: DataFrame) -> list:
    """All columns of ``df``, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame) -> list:
    """Columns that name a row of documents across scans: its id and a hash of its text. Rows that
    agree in both are copies of one another and get the same results."""
    return [F.col("doc_id"), F.xxhash64("text").alias("_th")]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of the undirected ``edges`` (u, v: long) the smallest node reachable.

    Alternating large-star and small-star steps: every step is an aggregate and an equality join, and
    the number of edges never grows, so no node or component has to fit in one task. Each round is
    written to the shared folder.
    """
    spark = edges.sparkSession
    now = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        after = written(small.filter("u <> v").distinct(), "cc")
        was, mark = mark, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(spark, now)
        now = after
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(now.select("v", "v").distinct())
