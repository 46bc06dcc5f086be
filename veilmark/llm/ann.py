"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into halves, each half is quantised by its own centroids, and a cell is a pair of
centroids. A query walks the cells from the best pair down (a heap over the two sorted lists of
centroid scores) until the cells passed hold the share of all rows that a calibration on the sample
asks for; all rows of those cells are then ranked by the exact inner product.

Cells are packed into blocks of about ``BLOCK`` rows, and a cell with more rows is dealt over several
blocks. A query is sent once to each block it needs. Each task holds the rows of one block and streams
the block's queries past it, so neither a common vector nor a popular cell has to fit in memory.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Numbers (vectors times dimensions) that the sample may hold.
SAMPLE = 1_000_000
#: Centroids of each half at most: the cells are counted on the driver.
CENTROIDS = 256
BLOCK = 4096
#: Share of the sample's true neighbours that the walk must pass.
RECALL = 0.97
SEED = 11


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, some component not zero, none null or not finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def centroids_for(rows: int) -> int:
    """Centroids of each half for a table: with the root of its rows, so that walking the cells costs a
    query less than ranking what they hold."""
    root = rows**0.5
    return max(1, min(CENTROIDS, int(max(min(32, root / 2), root / 4))))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


@dataclass
class MultiIndex:
    """Centroids of the two halves and the share of all rows that a walk has to pass."""

    left: np.ndarray
    right: np.ndarray
    share: float = 1.0

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def cell(self, x: np.ndarray) -> np.ndarray:
        d = self.left.shape[1]
        return _nearest(x[:, :d], self.left) * len(self.right) + _nearest(x[:, d:], self.right)

    def walk(self, q: np.ndarray):
        """Cells from the best sum of the centroids' inner products with ``q`` down."""
        d = self.left.shape[1]
        a, b = -(self.left @ q[:d]), -(self.right @ q[d:])
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, i, j = a[i].tolist(), b[j].tolist(), (i * len(j)).tolist(), j.tolist()
        heap = [(s + b[0], k, 0) for k, s in enumerate(a)]  # the next cell of each left centroid; sorted, so a heap
        while heap:
            _, s, t = heap[0]
            yield i[s] + j[t]
            if t + 1 < len(b):
                heapq.heapreplace(heap, (a[s] + b[t + 1], s, t + 1))
            else:
                heapq.heappop(heap)

    def probe(self, q: np.ndarray, sizes: list[int]) -> list[int]:
        need, out = self.share * sum(sizes), []
        for c in self.walk(q):
            if sizes[c]:
                out.append(c)
                need -= sizes[c]
                if need <= 0:
                    break
        return out

    @classmethod
    def fit(cls, x: np.ndarray, centroids: int | None = None, recall: float = RECALL, k: int = 20, seed: int = SEED) -> "MultiIndex":
        rng = np.random.default_rng(seed)
        half, n = x.shape[1] // 2, max(1, min(centroids or centroids_for(len(x)), len(x) // 4))
        out = cls(_k_means(x[:, :half], n, rng), _k_means(x[:, half:], n, rng))
        at = out.cell(x)
        sizes = np.bincount(at, minlength=out.cells)
        shares = []
        for r in rng.choice(len(x), min(100, len(x)), replace=False):
            passed = np.empty(out.cells)
            order = list(out.walk(x[r]))
            passed[order] = np.cumsum(sizes[order])
            score = x @ x[r]
            score[r] = -np.inf
            shares.append(passed[at[np.argsort(-score)[:k]]] / len(x))
        out.share = float(min(1.0, np.quantile(np.concatenate(shares), recall) + 1 / len(x)))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(ids: np.ndarray, rows: np.ndarray, cell: np.ndarray, q_ids: np.ndarray, q: np.ndarray, wanted: pa.ListArray, k: int):
    """(query, row, score) of the k best rows of the wanted cells for each query; ``ids`` ascend."""
    score = q @ rows.T
    names, code = np.unique(cell, return_inverse=True)
    allowed = np.zeros((len(q), len(names)), bool)
    asker, of = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
    here = np.isin(of, names)
    allowed[asker[here], np.searchsorted(names, of[here])] = True
    score[~allowed[:, code] | (q_ids[:, None] == ids[None, :])] = -np.inf
    if len(ids) > k:
        edge = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
        # the product may differ from the exact score in its last bits: all near the edge are scored anew
        margin = 4 * rows.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(rows, axis=1).max()
        hit = score >= (edge - np.where(np.isfinite(margin), margin, 0))[:, None]
    else:
        hit = np.ones_like(score, bool)
    at, row = np.nonzero(hit & (score > -np.inf))
    value = np.einsum("ij,ij->i", q[at], rows[row])
    order = np.lexsort((ids[row], -value, at))
    at, row, value = at[order], row[order], value[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    keep = place < k
    return q_ids[at[keep]], ids[row[keep]], value[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, **options) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) with the largest inner product, in double
    precision, found for each row of ``queries`` (vec_id, embedding): query_id, rank (from 1), vec_id,
    score. Nearest first, ties to the smaller vec_id. A query's own vec_id is no candidate.

    Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite
    components take no part; nor does a null vec_id. Repeated vec_ids are rows of their own as
    candidates; a repeated query with the same vector is searched once. Other columns are ignored. No
    usable vectors, no rows.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(usable("embedding") & F.col("vec_id").isNotNull())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a number of partitions of their own: walking is work that the queries' few bytes do not show
    rows, asked = clean(vectors), clean(queries).repartition(tasks, "vec_id").distinct()
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    d = sizes[0]
    rows, asked = rows.filter(F.size("embedding") == d), asked.filter(F.size("embedding") == d)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(20_000, sample // d))).toPandas()
    options = {"centroids": centroids_for(sizes[1])} | options
    index = MultiIndex.fit(np.stack(some["embedding"].to_numpy()).astype(np.float64), k=k, **options)
    sent = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.cell(_matrix(b.column(1))), pa.int32())], ["vec_id", "embedding", "cell"])

    placed = written(rows.mapInArrow(assign, "vec_id bigint, embedding array<double>, cell int"), "ann-index")
    counts = np.zeros(index.cells, np.int64)
    for c, n in placed.groupBy("cell").count().toLocalIterator():  # at most CENTROIDS squared rows
        counts[c] = n
    parts = -(-counts // BLOCK)  # cells above BLOCK rows are dealt over blocks of their own
    first, block, room = np.zeros(index.cells, np.int64), -1, 0
    for c in np.flatnonzero(counts).tolist():
        if parts[c] > 1:
            first[c], block, room = block + 1, block + parts[c], 0
        else:
            if counts[c] > room:
                block, room = block + 1, BLOCK
            first[c] = block
            room -= counts[c]
    layout = spark.sparkContext.broadcast((counts, first, parts))

    def send(batches):
        counts, first, parts = layout.value
        sizes = counts.tolist()
        for b in batches:
            q, ready = _matrix(b.column(1)), []
            for i in range(len(q)):
                wanted = np.array(sent.value.probe(q[i], sizes), np.int32)
                n = parts[wanted]
                block = np.repeat(first[wanted] - np.cumsum(n) + n, n) + np.arange(n.sum())
                order = np.argsort(block, kind="stable")
                block, wanted = block[order], np.repeat(wanted, n)[order]
                starts = np.flatnonzero(np.diff(block, prepend=-1))
                offsets = np.append(starts, len(block))
                for z in range(0, len(starts), 5000):  # a query may need every block
                    to = block[starts[z : z + 5000]]
                    cells = pa.ListArray.from_arrays(pa.array(offsets[z : z + len(to) + 1], pa.int32()), pa.array(wanted))
                    ids, vectors = (b.column(c).take(pa.array(np.full(len(to), i))) for c in (0, 1))
                    ready.append(pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), ids, vectors, cells], ["block", "id", "v", "cells"]))
                    if sum(map(len, ready)) >= 5000 or i + 1 == len(q):
                        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                        ready = []

    first_of, parts_of = (F.element_at(F.lit(x.tolist()), F.col("cell") + 1) for x in (first, np.maximum(parts, 1)))
    stored = placed.select(
        (first_of + F.pmod(F.xxhash64("vec_id"), parts_of)).alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"),
        F.col("embedding").alias("v"), F.array("cell").alias("cells"),
    )
    sent_out = asked.mapInArrow(send, "block bigint, id bigint, v array<double>, cells array<int>").select("block", F.lit(1).alias("kind"), "id", "v", "cells")

    def rank(batches):
        now, parts_, held = None, [], None
        for b in batches:
            block, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(block)]):
                if block[a] != now:
                    now, parts_, held = block[a], [], None
                part = b.slice(a, z - a)
                if kind[a] == 0:
                    parts_.append((part.column(2).to_numpy(), _matrix(part.column(3)), part.column(4).flatten().to_numpy()))
                    continue
                if held is None and parts_:
                    held = [np.concatenate(x) for x in zip(*parts_)]
                    order = np.argsort(held[0], kind="stable")
                    held = [x[order] for x in held]
                for i in range(0, z - a if held else 0, 256):
                    q = part.slice(i, 256)
                    out = _best(*held, q.column(2).to_numpy(), _matrix(q.column(3)), q.column(4), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    both = stored.union(sent_out).repartition(tasks, "block").sortWithinPartitions("block", "kind")
    found = both.mapInArrow(rank, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
