"""Periodic runs of words by Gusfield and Stoye's tandem-repeat method, on arrays.

A tandem repeat (square) is a stretch written twice in a row. The method has three steps:

1. The text is cut into Lempel-Ziv blocks. The leftmost place of every square crosses the start of a
   block, so that extensions to both sides of the block starts, as many as there are words, give a set
   of squares that covers the leftmost place of each.
2. From each of them the walk along suffix links (one word to the right at a time, as long as there is a
   square) visits the places in the suffix tree of all squares: the vocabulary. A place is an interval of
   the suffix array and a depth; each is kept once.
3. The leaves below a place are its occurrences. Occurrences of one period that stand one word apart
   merge into a run.

Squares whose half is itself a power are left out: their occurrences are inside runs of the shorter
period. All steps work on arrays for all walks, blocks and documents of a batch at once. Common
extensions are read off names of windows of 1, 2, 4, ... words, which costs a logarithm that pointers
would not.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_texts, space_words, utf8

#: Rows and bytes of text that are searched together; a longer text is searched alone.
ROWS, BYTES = 500, 4_000_000
#: Pairs of places compared at once.
PAIRS = 1_000_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Names:
    """Names of all windows of 1, 2, 4, ... symbols of a text whose last symbol stands nowhere else: two
    windows of a size have one name if they are equal, and names sort as the windows do."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        now = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.levels = []
        while True:
            self.levels.append(np.append(now, -1).astype(np.int32))
            if now.max() + 1 == n:
                break
            after = np.zeros(n, np.int64)
            size = 1 << (len(self.levels) - 1)
            after[: n - size] = now[size:] + 1
            now = np.unique((now << 32) | after, return_inverse=True)[1].astype(np.int64)
        self.rank = now
        self.order = np.empty(n, np.int64)
        self.order[now] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from the places i and j (never the same) on."""
        at, shift = i.copy(), j - i
        for k in reversed(range(len(self.levels))):
            names = self.levels[k]
            at += (names[at] == names[at + shift]).astype(np.int64) << k
        return at - i

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from i and j (i < j, -1 allowed) on to the left."""
        at, shift = i + 1, j - i
        for k in reversed(range(len(self.levels))):
            names, left = self.levels[k], at - (1 << k)
            same = (left >= 0) & (names[np.maximum(left, 0)] == names[np.maximum(left, 0) + shift])
            at -= same.astype(np.int64) << k
        return i + 1 - at


def blocks(names: Names) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: a block is the longest stretch that also starts further left, or one new symbol."""
    n, order, rank = names.n, names.order.tolist(), names.rank.tolist()
    before, after = list(range(-1, n)), list(range(1, n + 2))  # neighbours in the suffix array among places further left
    left, right = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        p, q = before[r], after[r]
        left[i], right[i] = p, q
        if p >= 0:
            after[p] = q
        if q < n:
            before[q] = p
    longest, here = np.zeros(n, np.int64), np.arange(n)
    for side in (np.array(left), np.array(right)):
        some = np.flatnonzero((side >= 0) & (side < n))
        longest[some] = np.maximum(longest[some], names.forward(here[some], names.order[side[some]]))
    step, starts, h = np.maximum(longest, 1).tolist(), [], 0
    while h < n:
        starts.append(h)
        h += step[h]
    return np.array(starts)


def _primitive(names: Names, at: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Which of the stretches of ``half`` symbols at ``at`` are no power of a shorter one."""
    top = int(half.max(initial=1)) + 1
    divisor = np.zeros(top, np.int64)
    for p in range(2, int(top**0.5) + 1):
        if divisor[p] == 0:
            multiples = divisor[p * p :: p]
            multiples[multiples == 0] = p
    divisor[divisor == 0] = np.arange(top)[divisor == 0]
    fine, rest = np.ones(len(at), bool), half.copy()
    while (some := np.flatnonzero(fine & (rest > 1))).size:
        p = divisor[rest[some]]
        part = half[some] // p
        fine[some] = names.forward(at[some], at[some] + part) < half[some] - part
        rest[some] //= p
    return fine


def covering(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(place, half): squares of halves that are no powers, such that each square's leftmost place is reached from one
    of them in steps to the right over squares of the same half."""
    starts = blocks(names)
    sizes = np.diff(np.append(starts, names.n))
    ends = starts + sizes
    follow = np.append(sizes[1:], 0)
    inner = ends < names.n
    # a square whose second half crosses the end of the block that its first half lies in; one whose first half crosses a start
    anchors = np.concatenate((ends[inner], starts))
    tops = np.concatenate((sizes[inner], np.minimum(sizes + follow, names.n - 1 - starts)))
    second = np.arange(len(anchors)) < inner.sum()
    found = [np.zeros((2, 0), np.int64)]
    cuts = np.searchsorted(np.cumsum(tops), np.arange(0, tops.sum() + PAIRS, PAIRS))
    for a, b in zip(cuts[:-1], np.append(cuts[1:-1], len(tops))):
        t = tops[a:b]
        half = ragged(np.ones(len(t), np.int64), t)
        h, back = np.repeat(anchors[a:b], t), np.repeat(second[a:b], t)
        low = np.where(back, h - half, h)
        some = np.flatnonzero(low >= 0)
        low, half = low[some], half[some]
        k1, k2 = names.forward(low, low + half), names.backward(low - 1, low + half - 1)
        at = np.maximum(low - k2, low - half + 1)
        some = np.flatnonzero((k1 + k2 >= half) & (k1 > 0) & (at >= 0))
        at, half = at[some], half[some]
        fine = _primitive(names, at, half)
        found.append(np.stack((at[fine], half[fine])))
    return tuple(np.concatenate(found, axis=1))


class Places:
    """Places of the suffix tree as intervals of the suffix array."""

    def __init__(self, names: Names):
        self.n = names.n
        least = np.append(np.append(-1, names.forward(names.order[:-1], names.order[1:])), -1).astype(np.int32)
        self.least = [least]  # of 1, 2, 4, ... neighbouring common prefixes
        while 2 << (len(self.least) - 1) <= self.n:
            size, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-size], last[size:]))

    def interval(self, rank: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that share ``depth`` symbols with that of ``rank``."""
        low, high = rank.copy(), rank.copy()
        for k in reversed(range(len(self.least))):
            size, least = 1 << k, self.least[k]
            there = low - size + 1
            fits = (there >= 0) & (least[np.maximum(there, 0)] >= depth)
            low -= fits.astype(np.int64) << k
            there = np.minimum(high + 1, len(least) - 1)
            fits = (high + size < self.n) & (least[there] >= depth)
            high += fits.astype(np.int64) << k
        return low, high


def runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal stretches at least twice as long as their smallest period, by period and
    start. The last symbol must stand nowhere else."""
    names = Names(symbols)
    at, half = covering(names)
    last = at + names.forward(at, at + half) - half
    keep = np.lexsort((at, last, half))
    at, half, last = at[keep], half[keep], last[keep]
    new = np.append(True, (half[1:] != half[:-1]) | (last[1:] != last[:-1]))[: len(at)]  # the leftmost of each run
    at, half, last = at[new], half[new], last[new]
    # the walk along suffix links: from each square to that one word further right
    steps = last - at + 1
    place, half = ragged(at, steps), np.repeat(half, steps)
    low, high = Places(names).interval(names.rank[place], 2 * half)
    kept = np.unique(np.stack((half, low)), axis=1, return_index=True)[1] if len(low) else np.zeros(0, np.int64)
    low, half, many = low[kept], half[kept], high[kept] - low[kept] + 1
    # the leaves below each place
    start, half = names.order[ragged(low, many)], np.repeat(half, many)
    keep = np.lexsort((start, half))
    start, half = start[keep], half[keep]
    new = np.append(True, (half[1:] != half[:-1]) | (start[1:] != start[:-1] + 1))[: len(start)]
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(start))[: len(first)] - 1
    return start[first], start[final] - start[first] + 2 * half[first], half[first]


def _suspects(ids: np.ndarray, owner: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of stretches outside of which no run of ``least`` words and ``exponent`` periods reaches.

    Every three words in a row of such a run stand in it at least exponent - 1 times (for a period of one
    word, length - 2 times). Places are counted by a hash, so that a chance collision only adds stretches.
    """
    need = max(1, min(exponent - 1, max(exponent, least) - 2))
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    sizes = np.diff(np.append(starts, len(ids)))
    before = -1
    while sizes.sum() != before:
        before = sizes.sum()
        fine = sizes >= (2 if need < 2 else max(3, least))
        starts, sizes = starts[fine], sizes[fine]
        if not len(starts) or need < 2:
            break
        group = np.repeat(np.arange(len(starts), dtype=np.uint64), sizes - 2)
        at = ragged(starts, sizes - 2)
        x = ids.view(np.uint64)
        key = (x[at] * np.uint64(0x9E3779B97F4A7C15) + x[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[at + 2]
        key = (key * np.uint64(0x165667B19E3779F9) + group) * np.uint64(0x9E3779B97F4A7C15)
        key >>= np.uint64(64 - min(26, int(8 * len(at)).bit_length()))
        often = np.bincount(key.view(np.int64))[key.view(np.int64)] >= need
        at, group = at[often], group[often]
        new = np.append(True, (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1]))[: len(at)]
        first = np.flatnonzero(new)
        starts, sizes = at[first], np.diff(np.append(first, len(at))) + 2
    return starts, sizes


def document_runs(documents: list[list[bytes]], least: int = 6, exponent: int = 4) -> list[np.ndarray]:
    """For each list of words an array of rows (start, length, period), by start and period: its maximal runs of
    ``least`` words and ``exponent`` periods at least."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in chain.from_iterable(documents)], np.int64)
    ends = np.cumsum([len(d) for d in documents])
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    found = np.zeros((0, 4), np.int64)
    starts, sizes = _suspects(ids, owner, least, exponent) if len(ids) else (np.zeros(0, np.int64),) * 2
    if len(starts):
        # stretches one after another, a symbol of its own behind each
        symbols = np.empty(sizes.sum() + len(sizes), np.int64)
        heads = np.cumsum(sizes + 1) - (sizes + 1)
        symbols[heads + sizes] = len(number) + np.arange(len(sizes))
        symbols[ragged(heads, sizes)] = ids[ragged(starts, sizes)]
        start, length, period = runs(symbols)
        fine = length >= np.maximum(least, exponent * period)
        start, length, period = start[fine], length[fine], period[fine]
        at = np.searchsorted(heads, start, "right") - 1
        start += starts[at] - heads[at]
        document = owner[start]
        found = np.stack((document, start - (ends - np.diff(np.append(0, ends)))[document], length, period), axis=1)
        found = found[np.lexsort((period, found[:, 1], document))]
    cuts = np.searchsorted(found[:, 0], np.arange(len(documents) + 1))
    return [found[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:])]


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def parts(batch: pa.RecordBatch, column: int, rows: int = ROWS, size: int = BYTES):
    """``batch`` in slices of at most ``rows`` rows and ``size`` bytes of a text column; a longer text comes alone."""
    many = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for k, n in enumerate(many):
        if k > at and (k - at == rows or held + n > size):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < len(many):
        yield batch.slice(at)


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, edit: Callable | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, runs (array of start, length, period by start and period),
    collapsed (the words that no run contains after its first period, joined by spaces).

    A run is a stretch of words with smallest period q, at least ``least`` words and ``exponent`` * q long, that no
    neighbour extends. ``edit`` (doc_id, words) gives the words to judge in place of a text's own. Whole texts are
    searched, no document leaves its row. Null and empty texts have no words and no runs; repeated rows get the same
    result; other columns are not read.
    """

    def search(batches):
        for batch in batches:
            for part in parts(batch, 1):
                words = [space_words(t) for t in utf8(part.column(1))]
                if edit is not None:
                    words = [edit(i, w) for i, w in zip(part.column(0).to_pylist(), words)]
                found = document_runs(words, least, exponent)
                cuts = np.append(0, np.cumsum([len(x) for x in found]))
                flat = np.concatenate(found)
                items = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], ["start", "length", "period"])
                left = [b" ".join(collapsed(w, f)) for w, f in zip(words, found)]
                made = [pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items)]
                made.append(pa.array(left, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), search, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")
