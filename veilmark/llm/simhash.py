"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most two
bits differ in at most one bit in one of the segments, so they share one of its 32 one-wildcard
variants: an equality join on (segment, wildcard, masked bits) finds every pair, and the exact
distance is checked in the join's condition. Exact copies are folded first, so the join sees each
fingerprint once.

A bucket of more than ``BUCKET`` fingerprints is not joined with itself. Its members are keyed by the
fingerprint with two of the bucket's varying bits masked: members that agree on such a key are within
two bits of each other, so linking each to the key's smallest member keeps every link in linear space.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, components, dealt, drop_written, fresh, map_texts, partitions_for, release, row_key, space_words, utf8, written

#: Buckets up to this size are joined pairwise; larger ones take the exact two-wildcard way.
BUCKET = 64
SEED = 42
#: _LANES[b] holds bit k of b in byte k, so that 255 of them can be summed without a carry.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """XXH64 of each ``width``-word shingle (one of all words if they are fewer; none for no words)."""
    words = space_words(text and text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    shingles = map(joined.__getitem__, map(slice, starts, (ends[width - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bit is 1 where over half of ``hashes`` have it set; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    lanes = _LANES[hashes.view(np.uint8).reshape(n, 8)]
    lanes = np.concatenate([lanes, np.zeros((-n % 255, 8), np.uint64)]).reshape(-1, 255, 8).sum(axis=1)
    counts = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, _th, fp): each row's key and its fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([majority(shingle_hashes(t, width)) for t in utf8(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps, pa.int64())], ["doc_id", "_th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select(*row_key(docs), "text"), run, f"doc_id {kind}, _th bigint, fp bigint")


def _signatures(fps: DataFrame) -> DataFrame:
    """64 rows (sig, fp) of each fp: segment in bit 37, wildcard's place in bits 32-36, masked segment below."""
    return fps.select(
        "fp",
        F.expr(
            "explode(transform(sequence(0, 63), j -> "
            "(shiftleft(cast(j as bigint), 32)) | "
            "(shiftrightunsigned(fp, (j div 32) * 32) & 4294967295L & ~shiftleft(1L, cast(j % 32 as int)))))"
        ).alias("sig"),
    )


def near_pairs(fps: DataFrame) -> DataFrame:
    """Edges (u, v) among the distinct longs ``fps`` (fp) that connect, directly or through others,
    exactly those that differ in at most two bits."""
    # 64 rows come of each fingerprint: dealt out evenly first, as a small table is in few files
    sigs = _signatures(fps.repartition(partitions_for(fps), "fp"))
    buckets = (
        sigs.groupBy("sig")
        .agg(F.count("*").alias("n"), F.expr("bit_or(fp) ^ bit_and(fp)").alias("varying"))
        .filter("n > 1")
    )
    shared = written(sigs.join(dealt(buckets), "sig"), "simhash-buckets")
    release(fps.sparkSession)
    some = shared.filter(F.col("n") <= BUCKET).select("sig", "fp")
    pairs = some.alias("a").join(
        dealt(some).alias("b"),
        F.expr(
            "a.sig = b.sig and a.fp < b.fp and bit_count(a.fp ^ b.fp) <= 2 and "
            # equal segments share all 32 wildcards: take the first only
            "((shiftright(a.sig, 32) & 31) = 0 or (shiftright(a.fp ^ b.fp, cast(shiftright(a.sig, 37) * 32 + (shiftright(a.sig, 32) & 31) as int)) & 1) = 1)"
        ),
    )
    hot = (
        shared.filter(F.col("n") > BUCKET)
        .groupBy("fp")
        .agg(F.expr("bit_or(varying)").alias("varying"))
        .withColumn("bits", F.expr("filter(sequence(0, 63), k -> (shiftright(varying, k) & 1) = 1)"))
        .select(
            "fp",
            F.expr(
                "explode(flatten(transform(bits, i -> transform(filter(bits, j -> j >= i), j -> "
                "struct(i * 64 + j as at, fp & ~(shiftleft(1L, i) | shiftleft(1L, j)) as rest)))))"
            ).alias("key"),
        )
    )
    star = hot.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    star = hot.join(dealt(star), "key").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).union(star)


def _rooted(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, least, root): each fingerprint's smallest doc_id and the
    smallest fingerprint that it is linked with."""
    spark = docs.sparkSession
    prints = written(fingerprints(docs, width), "simhash-prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    edges = near_pairs(classes.select("fp"))
    roots = components(edges)
    rooted = classes.join(dealt(roots), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = written(rooted, "simhash-roots")
    drop_written(spark, classes, edges, roots)
    release(spark)
    return prints, rooted


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """Group documents whose SimHash fingerprints differ in at most two bits, transitively.

    Takes ``doc_id`` and ``text`` (other columns are ignored) and returns one row for each input row:
    ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest doc_id reachable, the
    row's own included). Null and blank texts have fingerprint zero and are linked like any other. A
    null doc_id is never a component_id unless its component has no other. Repeated rows stay. No rows
    give no rows.
    """
    prints, rooted = _rooted(docs, width)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(dealt(least), "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(dealt(named), F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest doc_id, a row without
    an id only where its group has no other. All columns stay. Null and blank texts are one group; of
    repeated rows one stays; no rows give no rows.
    """
    return one_each(docs, *_rooted(docs, width))


def one_each(docs: DataFrame, prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root, from (doc_id, _th, fp) of all rows and (fp, root)."""
    # the smallest key of each fingerprint, then of each group: no step gathers a group's rows
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")
    kept = prints.groupBy("fp").agg(F.min(first).alias("k")).join(dealt(rooted), "fp").groupBy("root").agg(F.min("k").alias("k"))
    kept = written(kept.select("k.doc_id", "k._th"), "simhash-kept")
    th = fresh(docs, "_th")
    rows = docs.withColumn(th, F.xxhash64("text")).alias("d")
    out = rows.join(dealt(kept).alias("k"), F.expr(f"d.{th} = k._th and d.doc_id <=> k.doc_id"), "left_semi")
    n, distinct = prints.agg(F.count("*"), F.count_distinct(F.struct("doc_id", "_th"))).first()
    return (out if n == distinct else out.dropDuplicates(["doc_id", th])).select(columns(docs))
