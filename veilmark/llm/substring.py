"""Exact removal of repeated word windows, found by recompression.

Recompression names token runs and then token pairs, round after round. A name is a hash of what it
stands for, so it is the same everywhere in the corpus without a table of names; a pair is formed where
a symbol of the left half of the alphabet stands before one of the right half, the halves being drawn
anew each round by a bit of the name. Both rules look at neighbours only, so each symbol carries the
range of words that alone decides that it is formed there (``dl`` to ``dr``). Wherever those words
stand, that symbol stands: equal substrings have equal interior symbols.

Every window picks, among the symbols whose deciding words lie inside it, the one with the least
scrambled name. Equal windows pick equal symbols at equal offsets, so a window can be repeated only if
its symbol is shared. One row goes to the shuffle for each *picked symbol* (about one in a dozen words),
with a hash of all words that its windows cover: where these agree in all occurrences, all its windows
are repeated. The rest, the edges of repeats, is settled window by window with 128 bits of hash:
two polynomials, each over word hashes of its own.
Windows in which no symbol is decided (long runs of one word) go straight to that last step.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, map_texts, release, row_key, space_words, utf8, written

WINDOW = 35
ROUNDS = 3
#: Words handled at once by a worker, if no single text is longer.
CHUNK = 250_000
_P1, _P2 = 0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93 | 5
_EMPTY = np.zeros(0, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Ranges:
    """Hashes of any range of a sequence of 64-bit numbers, by prefix sums of a polynomial."""

    def __init__(self, h: np.ndarray, base: int):
        n = len(h) + 1
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(h * np.multiply.accumulate(powers)[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


def recompress(h: np.ndarray, rounds: int = ROUNDS):
    """(name, start, dl, dr) of the symbols after ``rounds`` of run and pair naming of ``h``, which must
    begin and end with a sentinel of its own."""
    name = h
    st = np.arange(len(h))
    dl, dr = st, st + 1
    for r in range(rounds):
        m = len(name)
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        last = np.concatenate((first[1:], [m])) - 1
        runs = (last - first).astype(np.uint64)
        name = np.where(runs > 0, _mix(name[first] + _mix(runs)), name[first])
        st, dl, dr = st[first], dl[np.maximum(first - 1, 0)], dr[np.minimum(last + 1, m - 1)]
        right = (_mix(name + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
        pair = np.concatenate((~right[:-1] & right[1:], [False]))  # by its first symbol
        tail = np.concatenate(([False], pair[:-1]))
        after = np.concatenate((name[1:], name[-1:]))
        joined = _mix(_mix(name) * np.uint64(3) + after)
        # a symbol of the right half that stays alone is decided by its left neighbour, one of the left half by its right one
        dl = np.where(right, np.concatenate((dl[:1], dl[:-1])), dl)
        dr = np.where(right, dr, np.concatenate((dr[1:], dr[-1:])))
        keep = ~tail
        name, st, dl, dr = np.where(pair, joined, name)[keep], st[keep], dl[keep], dr[keep]
    return name, st, dl, dr


def _least(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the first least value of v[lo:hi] for each (nonempty) range."""
    out = np.empty(len(lo), np.int64)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    table = np.arange(len(v))
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            a, b = table[:-half], table[half:]
            table = np.where(v[a] <= v[b], a, b)
        at = np.flatnonzero(level == k)
        a, b = table[lo[at]], table[hi[at] - (1 << k)]
        out[at] = np.where(v[a] <= v[b], a, b)
    return out


def _word_hashes(words: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
    return np.fromiter(map(digest, words, repeat(7)), np.uint64, len(words))


#: Hashes of words, one for each polynomial: words that agree in one of them by chance differ in the other.
_DIGESTS = (xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest)


def _picked(texts: list[list[bytes]], width: int, salt: int):
    """Per text: arrays (symbol, context, first window, further windows) of the picked symbols."""
    sizes = np.array([len(w) for w in texts])
    starts = np.concatenate(([0], np.cumsum(sizes + 1))) + 1  # a sentinel before each text and at the end
    n = int(starts[-1])
    h = np.empty((2, n), np.uint64)
    gaps = starts - 1
    h[:, gaps] = _mix(np.arange(len(gaps), dtype=np.uint64) + np.uint64(salt))
    for a, w in zip(starts.tolist(), texts):
        for row, digest in zip(h, _DIGESTS):
            row[a : a + len(w)] = _word_hashes(w, digest)
    name, st, dl, dr = recompress(h[0])
    one, two = _Ranges(h[0], _P1), _Ranges(h[1], _P2)
    # windows that lie in one text
    text_of = np.repeat(np.arange(len(texts)), np.maximum(sizes - width + 1, 0))
    counts = np.maximum(sizes - width + 1, 0)
    p = np.arange(len(text_of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text_of]
    lo = np.concatenate(([0], np.cumsum(np.bincount(dl, minlength=n + 1))))[p]
    hi = np.cumsum(np.bincount(dr, minlength=n + 1))[p + width]
    some = hi > lo
    q = p[some]
    pick = _least(_mix(name), lo[some], hi[some])
    head = np.flatnonzero(np.concatenate(([True], (pick[1:] != pick[:-1]) | (q[1:] != q[:-1] + 1)))) if len(q) else _EMPTY
    end = np.concatenate((head[1:], [len(q)])) - 1 if len(q) else _EMPTY
    p1, p2, s = q[head], q[end], pick[head]
    symbol = _mix(_mix(one.of(dl[s], dr[s])) + name[s] + (st[s] - dl[s]).astype(np.uint64))
    context = _mix(_mix(two.of(p1, p2 + width)) + ((st[s] - p1) * 64 + (p2 - p1)).astype(np.uint64))
    r = p[~some]
    at = np.concatenate((p1, r))
    order = np.argsort(at, kind="stable")
    at = at[order]
    symbol = np.concatenate((symbol, _mix(one.of(r, r + width)))).view(np.int64)[order]
    context = np.concatenate((context, _mix(two.of(r, r + width)))).view(np.int64)[order]
    more = np.concatenate((p2 - p1, np.zeros(len(r), np.int64)))[order]
    bounds = np.searchsorted(at, starts)
    return symbol, context, at - starts[np.searchsorted(starts, at, side="right") - 1] if len(at) else at, more, bounds


def _symbols(docs: DataFrame, width: int) -> DataFrame:
    """One row for each text with windows: rid, doc_id, _th and the arrays of its picked symbols."""

    def run(batches):
        for b in batches:
            texts = utf8(b.column(3))
            at = 0
            while at < len(texts):
                part, n, begin = [], 0, at
                while at < len(texts) and (not part or n < CHUNK):
                    part.append(space_words(texts[at]))
                    n += len(part[-1])
                    at += 1
                symbol, context, first, more, bounds = _picked(part, width, int(xxhash.xxh64_intdigest(str(begin), n)))
                offsets = pa.array(bounds.astype(np.int32))
                where = pa.array(first * 64 + more)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x) if isinstance(x, np.ndarray) else x) for x in (symbol, context, where)]
                made = pa.RecordBatch.from_arrays([*(c.slice(begin, at - begin) for c in b.columns[:3]), *lists], ["rid", "doc_id", "_th", "x", "c", "w"])
                yield made.filter(pa.array(np.diff(bounds) > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *row_key(docs), "text")
    return map_texts(rows, run, f"rid bigint, doc_id {kind}, _th bigint, x array<bigint>, c array<bigint>, w array<bigint>")


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """(rid, w, h1, h2) of the windows in the array ``ws`` of (first window * 64 + further windows)."""

    def run(batches):
        for b in batches:
            for rid, text, ws in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2)):
                ws = np.unique(ws.values.to_numpy(zero_copy_only=False))
                p = np.repeat(ws // 64, ws % 64 + 1)
                p = p + np.arange(len(p)) - np.repeat(np.cumsum(ws % 64 + 1) - (ws % 64 + 1), ws % 64 + 1)
                words = space_words(text)
                hs = [_mix(_Ranges(_word_hashes(words, digest), base).of(p, p + width)).view(np.int64) for digest, base in zip(_DIGESTS, (_P1, _P2))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), rid)), pa.array(p * 64), *map(pa.array, hs)], ["rid", "w", "h1", "h2"])

    return map_texts(rows.select("rid", "text", "ws"), run, "rid bigint, w bigint, h1 bigint, h2 bigint")


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, _th, ws): for each row key with any, the windows whose ``width`` words also start
    elsewhere, as first window * 64 + further windows. ``width`` may be 2 to 64."""
    spark = docs.sparkSession
    symbols = written(_symbols(docs, width), "repeat-symbols")
    keys = symbols.select("rid", "doc_id", "_th")
    found = symbols.select("rid", F.explode(F.arrays_zip("x", "c", "w")).alias("s")).select("rid", "s.x", "s.c", "s.w")
    counts = found.groupBy("x").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("open")).filter("n > 1")
    # written before the join, which then deals both sides out anew and can split a symbol that is everywhere
    counts = written(counts.select("x", "open"), "repeat-counts")
    shared = written(found.join(counts, "x").select("rid", "w", "open"), "repeat-shared")
    release(spark)
    open_ = shared.filter("open").groupBy("rid").agg(F.collect_list("w").alias("ws")).join(keys, "rid")
    texts = docs.select(*row_key(docs), "text").alias("d")
    rows = open_.alias("o").join(texts, F.expr("o._th = d._th and o.doc_id <=> d.doc_id"))
    rows = rows.dropDuplicates(["rid"]) if _has_copies(keys) else rows
    windows = written(_windows(rows.select("rid", "text", "ws"), width), "repeat-windows")
    release(spark)
    again = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = written(again, "repeat-again")
    settled = windows.join(again, ["h1", "h2"]).select("rid", "w")
    each = shared.filter(~F.col("open")).select("rid", "w").union(settled).groupBy("rid").agg(F.collect_list("w").alias("ws"))
    out = each.join(keys, "rid").groupBy("doc_id", "_th").agg(F.flatten(F.collect_list("ws")).alias("ws"))
    out = written(out, "repeat-windows-found")
    drop_written(spark, symbols, counts, shared, windows, again)
    release(spark)
    return out


def _has_copies(keys: DataFrame) -> bool:
    """Whether some rows share id and text, so that a join by key would pair them."""
    n, distinct = keys.agg(F.count("*"), F.count_distinct(F.struct("doc_id", "_th"))).first()
    return n != distinct


def covered(n_words: int, ws, width: int) -> np.ndarray:
    """Which words the windows ``ws`` cover."""
    hit = np.zeros(n_words + 1, np.int64)
    if ws is not None and len(ws):
        ws = np.asarray(ws)
        np.add.at(hit, ws // 64, 1)
        np.add.at(hit, ws // 64 + ws % 64 + width, -1)
    return hit[:-1].cumsum() > 0


def without_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Remove every word that lies in a window of ``width`` words which also starts anywhere else, in the
    same text or another; windows are judged on the input.

    Returns one row for each row of ``docs``: doc_id, n_words, n_removed and kept, the remaining words
    joined by one space. Words are runs of anything but ASCII white space; null and blank texts have
    none. Rows with the same id and text are copies of one another, so all their windows are repeats.
    """
    found = repeated_windows(docs, width)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n_words, n_removed, kept = [], [], []
                for text, ws in zip(utf8(part.column(1)), part.column(2)):
                    words = space_words(text)
                    n_words.append(len(words))
                    if ws.is_valid:
                        hit = covered(len(words), ws.values.to_numpy(zero_copy_only=False), width)
                        words = [w for w, h in zip(words, hit.tolist()) if not h]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(*row_key(docs), "text").alias("d").join(found.alias("f"), F.expr("d._th = f._th and d.doc_id <=> f.doc_id"), "left")
    return map_texts(rows.select("d.doc_id", "text", "ws"), run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def digest(cleaned: DataFrame) -> DataFrame:
    """One row a document with a hash of the words kept."""
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
