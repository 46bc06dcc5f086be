"""Levenshtein distance of long texts, in time that grows with how much they differ.

The built-in distance fills a table of one text's length by the other's. Here the common ends are cut off
first. Then the furthest place that each diagonal of the table reaches with 0, 1, 2, ... edits is followed
until the corner is reached, all diagonals at once: for texts that differ little this touches little more
than the differences. Past ``NEAR`` edits the rest is worked out bit-parallel, a whole column of the table
in a few operations on one long integer. Both are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .binding import let

#: Cells of the table up to which the built-in distance is used.
CELLS = 1_000_000
#: Edits up to which diagonals are followed.
NEAR = 1000
#: Lengths that are compared at once while a diagonal slides over equal letters.
_SLIDE = 8


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(n, at + step)
        differ = a[at:end] != b[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, 2 * step
    return n


def _by_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The distance if it is ``most`` or less."""
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > most:
        return None
    # padded with letters that nothing equals, so that no diagonal leaves the texts
    pad = most + _SLIDE + 2
    a_, b_ = np.append(a.astype(np.int64), np.full(pad, -1)), np.append(b.astype(np.int64), np.full(pad, -2))
    # furthest row on diagonal k - most - 1 (column less row); -2: not reached
    reach = np.full(2 * most + 3, -2, np.int64)
    steps = np.arange(_SLIDE)
    for e in range(most + 1):
        k = np.arange(-e, e + 1)
        at = k + most + 1
        if e == 0:
            row = np.zeros(1, np.int64)
        else:
            row = np.maximum(np.maximum(reach[at] + 1, reach[at - 1]), reach[at + 1] + 1)
        inside = (row >= 0) & (row <= n) & (row + k >= 0) & (row + k <= m)
        k, at, row = k[inside], at[inside], row[inside]
        same = a_[row[:, None] + steps] == b_[(row + k)[:, None] + steps]
        slid = np.where(same.all(axis=1), _SLIDE, same.argmin(axis=1))
        row = row + slid
        for x in np.flatnonzero(slid == _SLIDE).tolist():  # few: those along a long equal stretch
            i = int(row[x])
            row[x] = i + _equal(a[i:], b[i + int(k[x]) :])
        reach[at] = row
        if goal >= -e and goal <= e and reach[goal + most + 1] >= n:
            return e
    return None


def _by_bits(a: str, b: str) -> int:
    """The distance by columns of differences held as bits of one integer."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    masks = {c: _mask(x, m) for c, x in places.items()}
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m  # where the next row is one more, one less
    for c in b:
        match = masks.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | (every & ~(diagonal | up)), diagonal & up
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1) | 1, left << 1
        up, down = (left | ~(diagonal | right)) & every, right & diagonal & every
    return score


def _mask(places: list[int], size: int) -> int:
    bits = np.zeros(size, np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements of code points that turn ``a`` into ``b``."""
    x, y = _codes(a), _codes(b)
    begin = _equal(x, y)
    x, y = x[begin:], y[begin:]
    end = _equal(x[::-1], y[::-1])
    x, y = x[: len(x) - end], y[: len(y) - end]
    if not len(x) or not len(y):
        return len(x) + len(y)
    found = _by_diagonals(x, y, min(NEAR, max(len(x), len(y))))
    return _by_bits(a[begin : len(a) - end], b[begin : len(b) - end]) if found is None else found


@F.pandas_udf(IntegerType())
def _long(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int32")


#: 2^30, ..., 2, 1.
_POWERS = [1 << k for k in reversed(range(31))]


def _common(a: Column, b: Column, part) -> Column:
    """Length of the longest end, cut out by ``part`` (text, length), that two texts have in common: bit by bit."""
    n = F.least(F.length(a), F.length(b))
    steps = lambda most: F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p <= most)
    longer = lambda most: lambda have, p: F.when((have + p <= most) & (part(a, have + p) == part(b, have + p)), have + p).otherwise(have)
    return let(n, lambda most: F.aggregate(steps(most), F.lit(0), longer(most)))


def levenshtein(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points; null if either is null. Pairs of texts whose table is small take the built-in
    function, without their common ends; the others go to Python by Arrow."""
    large = (F.length(a).cast("long") * F.length(b) > CELLS) & (a != b)
    head = lambda s: _common(s["a"], s["b"], lambda t, n: F.substring(t, F.lit(1), n))
    rest = lambda s, n: F.struct(F.substring(s["a"], n + 1, F.length(s["a"])).alias("a"), F.substring(s["b"], n + 1, F.length(s["b"])).alias("b"))
    tail = lambda s: _common(s["a"], s["b"], lambda t, n: F.right(t, n))
    cut = lambda s, n: F.levenshtein(F.substring(s["a"], F.lit(1), F.length(s["a"]) - n), F.substring(s["b"], F.lit(1), F.length(s["b"]) - n))
    both = F.struct(a.alias("a"), b.alias("b"))
    small = let(both, lambda s: let(head(s), lambda n: let(rest(s, n), lambda r: let(tail(r), lambda k: cut(r, k)))))
    return F.when(a == b, 0).when(large, _long(F.when(large, a), F.when(large, b))).otherwise(small)
