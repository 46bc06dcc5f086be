"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are complete binary trees of one depth, kept as three arrays (feature, threshold and leaf
value by tree and node); scoring moves all rows of a batch down one level at a time with numpy.
Training uses a bounded sample of labelled rows (``SAMPLE``); scoring reads every whole text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import columns, map_texts, utf8

#: At most so many labelled rows are learned from, those with the smallest seeded hashes.
SAMPLE = 20_000
THRESHOLD = 0.7

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence marks, 6 other ASCII marks, 7 control, 8 non-ASCII.
_CLASS = np.array(
    [
        0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b" \t" else 4 if c in b"\r\n"
        else 5 if c in b".,;:'\"?()-" else 8 if c >= 128 else 7 if c < 32 or c == 127 else 6
        for c in range(256)
    ],
    np.uint8,
)
FEATURES = (
    "log_bytes", "lower", "upper", "digit", "blank", "line_end", "sentence", "mark", "control", "non_ascii",
    "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "alone_marks", "shout_words",
    "marked_words", "log_lines", "words_a_line", "distinct_lines", "top_line", "distinct_pairs", "sentence_ends",
)


def statistics(text: bytes | None) -> list[float]:
    """The FEATURES of one whole text; null counts as empty."""
    text = text or b""
    n = max(1, len(text))
    share = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9)[:9] / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    w, k = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    marked = sum(c for x, c in counts.items() if x[-1] < 128 and _CLASS[x[-1]] == 6)
    alone = sum(c for x, c in counts.items() if len(x) == 1 and _CLASS[x[0]] >= 5 and x[0] < 128)
    shout = sum(c for x, c in counts.items() if len(x) > 1 and x.isupper())
    ends = sum(c for x, c in counts.items() if x[-1] in b".?!")
    top_line = Counter(lines).most_common(1)[0][1] if lines else 0
    return [
        np.log1p(len(text)), *share, np.log1p(len(words)), lengths.mean(), lengths.std(), len(counts) / w,
        max(counts.values(), default=0) / w, alone / w, shout / w, marked / w, np.log1p(len(lines)), len(words) / k,
        len(set(lines)) / k, top_line / k, len(set(zip(words, words[1:]))) / w, ends / w,
    ]


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold``: trees x inner nodes in heap order; ``leaf``: trees x leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 10) -> Trees:
    """Fit ``Trees`` by second-order boosting of the logistic loss on quantile histograms.

    ``least`` rows at least on either side of a split. With one class or no rows the score is constant.
    """
    mean = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    total, made = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain, best_f, best_c = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            for f in range(x.shape[1]):
                key = (node - first) * bins + codes[:, f]
                sums = [np.bincount(key, weights, width * bins).reshape(width, bins) for weights in (g, h, None)]
                left = [s.cumsum(axis=1) for s in sums]
                whole = [s[:, -1:] for s in left]
                right = [b - a for a, b in zip(left, whole)]
                value = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
                value[(left[2] < least) | (right[2] < least)] = -1
                at = value.argmax(axis=1)
                top = value[np.arange(width), at]
                better = top > gain
                gain[better], best_f[better], best_c[better] = top[better], f, at[better]
            for k in range(width):
                if best_c[k] >= 0:
                    feature[first + k], threshold[first + k] = best_f[k], cuts[best_f[k]][best_c[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        total += leaf[at]
        made.append((feature, threshold, leaf))
    return Trees(base, *(np.stack(a) for a in zip(*made)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``x``, the statistics of each row's text."""

    def run(batches):
        for b in batches:
            flat = np.array([statistics(t) for t in utf8(b.column(len(keep)))], np.float64).reshape(-1)
            x = pa.FixedSizeListArray.from_arrays(pa.array(flat), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], x], [*keep, "x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(docs.select(*keep, "text"), run, f"{kinds}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Trees:
    """Learn ``labels.quality`` (0 or 1) of the rows that are not ``held_out``.

    Rows with a null id or label take no part; an id with several labels counts once for each distinct
    label. ``sample`` bounds the rows learned from.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    known = known.select("doc_id", F.col("quality").alias("_y")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `sample` rows of two numbers
    rows = _measured(rows, ["doc_id", "_y"]).orderBy(F.xxhash64("doc_id"), "doc_id", "_y", "x").limit(sample).toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return train(x, rows["_y"].to_numpy(np.float64), **options)


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with all its columns as a struct ``doc``, and ``score`` (0 to 1). Null texts score as empty
    ones, repeated rows alike; no rows give no rows."""

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in utf8(b.column(1))], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], ["doc", "score"])

    rows = docs.select(F.struct(*columns(docs)).alias("doc"), F.col("text").alias("text"))
    return map_texts(rows, run, StructType([rows.schema["doc"], StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1, higher: label 1 likelier) and
    predicted (1 if score >= ``threshold``).

    Only ``text`` is an input of a score. Null texts score as empty ones; a null doc_id is not held out;
    without usable labels every score is the constant 0.5. Repeated rows score alike.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return out.select(
        "doc.doc_id", held_out("doc.doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns stay, and each repeated row.
    Null texts score as empty ones; without usable labels every score is 0.5; no rows give no rows."""
    return scored(docs, fit(docs, labels, **options)).filter(F.col("score") >= threshold).select("doc.*")
