"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Targets: every source gets its weight's share of the total; a source above ``max_epochs`` times its own
size is clamped there and the excess goes to the others in proportion to their weights, until none is
above. Each round is one aggregate over the table of sources.

Sampling: a source with target t and size s gives every document floor(t / s) whole repetitions. The
rest of the target is filled with one more repetition of documents in the order of a seeded hash, each
taken if it still fits (first fit). Sums over hash buckets find the first document that does not fit,
without ordering the source; from there on the walk goes on in rounds. A round takes the documents
that are still ahead and no larger than what is left, walks the first buckets of them that hold ``POOL``
rows in order, and leaves the rest to the next round: what is left falls below the largest document at
once and then with every round, until nothing is left or nothing ahead is small enough. No task holds
more than a few buckets of a source, and a bucket holds about ``BUCKET`` rows at any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, columns, drop_written, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Bits of the seeded hash.
BITS = 52
#: Rows of a source that a hash bucket holds on average, at most.
BUCKET = 1024
#: Rows that a round walks in order, and those of their last bucket.
POOL = 4096


def word_count(text: str = "text") -> Column:
    """Number of white-space words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def seeded(seed: int, column: str = "doc_id") -> Column:
    """52 bits of a seeded hash of a row's id, as a long."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): water-filling.

    Sources in code point order (null last) weigh ``weights``, repeating. The number of sources is that
    of one row each; rounds stop when no further source is clamped.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    cap = max_epochs * F.col("source_size")
    table = written(
        sizes.select(
            "source", "source_size", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1).alias("weight")
        ),
        "mix-sources",
    )
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, before = 0.0, -1
    while True:
        clamped = F.col("weight") * F.lit(level) > cap
        n, held, free = table.agg(
            F.count_if(clamped),
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)),
        ).first()
        if n == before or not free:
            break
        before, level = n, (total - held) / free if level else total / free
        if n == 0 and level == 0:
            break
    target = F.when(clamped, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return table.withColumn("target", target)


def _walk(pool: pd.DataFrame) -> pd.DataFrame:
    """First fit through the rows (u, size) of one source in the order of u, from what is ``need``ed: the
    first that does not fit, if that is yet to be found (``first``), and those taken behind it."""
    pool = pool.sort_values("u")
    need, cut, taken, first = int(pool["need"].iloc[0]), None, [], bool(pool["first"].iloc[0])
    for u, size in zip(pool["u"].tolist(), pool["size"].tolist()):
        if size <= need:
            need -= size
            taken.append(u)
        elif first and cut is None:
            cut, taken = u, []
    return pd.DataFrame(
        {"source": [pool["source"].iloc[0]], "cut": [cut], "taken": [np.array(taken, np.int64)], "need": [need], "at": [int(pool["u"].iloc[-1])]}
    )


def _first_fit(units: DataFrame, wanted: DataFrame, kind: str, pool: int, rows: int) -> DataFrame:
    """(source, cut, taken) from the ``rows`` ``units`` (source, u, size above 0) and ``wanted`` (source,
    need above 0): the first u that does not fit, null if all do, and those behind it that do."""
    spark = units.sparkSession
    low = BITS - min(40, max(0, -(-rows // BUCKET) - 1).bit_length())
    bucket = F.shiftright("u", low).alias("bucket")
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    schema = f"source {kind}, cut bigint, taken array<bigint>, need bigint, at bigint"
    state = written(wanted.select("source", "need", F.lit(-1).cast("long").alias("at")), "mix-state")
    found, first = None, True
    while True:
        ahead = units.alias("r").join(state.alias("s"), F.expr("r.source <=> s.source and r.u > s.at"))
        # before the first misfit every document counts; then those that are small enough
        ahead = ahead if first else ahead.filter("r.size <= s.need")
        ahead = ahead.select("r.source", "u", "size", "need")
        sums = ahead.groupBy("source", bucket).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("need").alias("need"))
        if first:  # from the bucket that holds the first misfit on
            sums = sums.withColumn("up_to", F.sum("size").over(by_bucket)).filter("up_to > need")
            sums = sums.withColumn("need", F.first(F.col("need") - F.col("up_to") + F.col("size")).over(by_bucket))
        sums = sums.withColumn("before", F.sum("n").over(by_bucket) - F.col("n")).filter(F.col("before") < pool)
        here = ahead.drop("need").withColumn("bucket", bucket).alias("r").join(sums.alias("s"), F.expr("r.source <=> s.source and r.bucket = s.bucket"))
        walked = written(here.select("r.source", "u", "r.size", "s.need", F.lit(first).alias("first")).groupBy("source").applyInPandas(_walk, schema), "mix-walked")
        drop_written(spark, state)
        some = walked.select("source", "cut", "taken")
        found = some if first else found.union(some)
        state = written(walked.filter("need > 0").select("source", "need", "at"), "mix-state")
        first = False
        if walked.isEmpty() or state.isEmpty():
            drop_written(spark, state)
            break
    return found.groupBy("source").agg(F.min("cut").alias("cut"), F.flatten(F.collect_list("taken")).alias("taken"))


def plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, pool: int = POOL) -> DataFrame:
    """(source, source_size, target, whole, budget, cut, extras): how often documents of each source are
    taken: ``whole`` times, and, to fill ``budget`` words, once more if they are empty or their hash is below
    ``cut`` or among ``extras``. ``pool`` sets how many rows a round of the first fit walks, not what it finds."""
    rows = written(docs.select("source", seeded(seed).alias("u"), word_count().alias("size")), "mix-sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    table = written(
        sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.floor(F.col("target") - F.col("whole") * F.col("source_size"))),
        "mix-targets",
    )
    kind = docs.schema["source"].dataType.simpleString()
    units = written(rows.groupBy("source", "u").agg(F.sum("size").alias("size")).filter("size > 0"), "mix-units")
    wanted = table.filter("budget > 0").select("source", F.col("budget").alias("need"))
    cuts = _first_fit(units, wanted, kind, pool, units.count())
    out = (
        table.alias("t")
        .join(cuts.alias("c"), F.expr("t.source <=> c.source"), "left")
        # without a document that does not fit the budget holds every one, or is zero
        .select(
            "t.source", "source_size", "target", "whole", "budget",
            F.coalesce("cut", F.when(F.col("budget") > 0, F.lit(1 << BITS)).otherwise(F.lit(0))).alias("cut"),
            F.coalesce("taken", F.array().cast("array<bigint>")).alias("extras"),
        )
    )
    out = written(out, "mix-plan")
    drop_written(docs.sparkSession, rows, sources, cuts, table, units)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` (with doc_id, text, source) as a struct ``doc`` beside ``size``, ``source_size``,
    ``target`` and ``copies``, the number of times that the mix takes the row (0 to ``max_epochs``).

    Null and blank texts have size 0 and always fit where a source has any words left to fill. Null is a source of its own, the last in order. A source of size 0 has target 0. Rows of one source
    with the same doc_id are taken together. No rows give no rows.
    """
    plan_ = plan(docs, weights, max_epochs, seed).withColumnsRenamed({c: f"_{c}" for c in ("source", "source_size", "target", "whole", "budget", "cut", "extras")})
    extra = (F.col("_u") < F.col("_cut")) | F.array_contains("_extras", F.col("_u")) | ((F.col("_size") == 0) & (F.col("_budget") > 0))
    rows = docs.select(F.struct(*columns(docs)).alias("doc"), word_count().alias("_size"), seeded(seed).alias("_u"))
    return rows.join(plan_, F.col("doc.source").eqNullSafe(F.col("_source"))).select(
        "doc",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_whole") + extra.cast("long")).cast("long").alias("copies"),
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as ``mix`` takes it, with the same columns. Null,
    empty and repeated texts count as in ``mix``; no rows give no rows."""
    taken = mix(docs, **options).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
