"""Benchmark decontamination with a generalised suffix automaton.

The automaton of the normalised items is built on the driver for at most ``BLOCK`` item words at a
time; a larger benchmark is cut into several automata, each small enough to be sent to every task, and
the documents are read once for each. Training tokens stream through it and the length of the longest
match that ends at each word is tracked; words that no item has reset it, so only stretches of known
words that are long enough for a window are walked.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import ALNUM_TABLE, alnum_words, columns, drop_written, map_texts, row_key, utf8, written

WINDOW = 10
#: Words of items in one automaton (at most two states a word).
BLOCK = 200_000


@dataclass
class Automaton:
    """Suffix automaton of several token sequences with, for each state, the items whose window it shows.

    ``nexts[s]`` maps a token to a state; ``link`` and ``length`` are the suffix link and the longest
    string of a state. ``long_items[s]``: items that have the ``window``-word string of state s.
    ``short_items[s]``: (length, item) of the items shorter than a window that are suffixes of state s's
    strings, by way of the links.
    """

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    nexts: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[str] = field(default_factory=list)
    long_items: dict[int, tuple[int, ...]] = field(default_factory=dict)
    short_items: dict[int, tuple[tuple[int, int], ...]] = field(default_factory=dict)
    least: int = 0
    #: Items of the same words: the first of them, which stands for all, and the others.
    alike: dict[int, list[int]] = field(default_factory=dict)

    def _state(self, nexts: dict[int, int], link: int, length: int) -> int:
        self.nexts.append(nexts)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the strings of q up to one token longer than p's longest."""
        clone = self._state(dict(self.nexts[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.nexts[p].get(c) == q:
            self.nexts[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.nexts[last].get(c)
        if q is not None:  # an earlier item has this prefix
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and c not in self.nexts[p]:
            self.nexts[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.nexts[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> "Automaton":
        a = cls(window)
        coded: list[list[int]] = []
        seen: dict[tuple[int, ...], int] = {}
        for name, words in items:
            if words:
                tokens = [a.vocabulary.setdefault(w, len(a.vocabulary)) for w in words]
                first = seen.setdefault(tuple(tokens), len(a.items))
                if first < len(a.items):
                    a.alike.setdefault(first, []).append(len(a.items))
                coded.append(tokens if first == len(a.items) else [])
                a.items.append(name)
        for tokens in coded:
            last = 0
            for c in tokens:
                last = a._extend(last, c)
        long: dict[int, set[int]] = {}
        short: dict[int, set[tuple[int, int]]] = {}
        for k, tokens in enumerate(coded):
            if not tokens:
                continue
            if len(tokens) < window:
                state = 0
                for c in tokens:
                    state = a.nexts[state][c]
                short.setdefault(state, set()).add((len(tokens), k))
            else:
                for i, state, _ in a.walk(tokens):
                    if i >= window - 1:
                        while a.length[a.link[state]] >= window:
                            state = a.link[state]
                        long.setdefault(state, set()).add(k)
        a.long_items = {s: tuple(sorted(v)) for s, v in long.items()}
        if short:  # pass the short items on to the states below them, shortest strings first
            for s in sorted(range(1, len(a.link)), key=a.length.__getitem__):
                if up := short.get(a.link[s]):
                    short[s] = short.get(s, set()) | up
            a.short_items = {s: tuple(sorted(v)) for s, v in short.items()}
        a.least = min(window, min((len(tokens) for tokens in coded if tokens), default=0))
        return a

    def walk(self, tokens):
        """(position, state, length of the longest match that ends there) for each token; -1: unknown."""
        nexts, link, length = self.nexts, self.link, self.length
        state = matched = 0
        for i, c in enumerate(tokens):
            after = nexts[state].get(c)
            while after is None and state:
                state = link[state]
                matched = length[state]
                after = nexts[state].get(c)
            if after is not None:
                state, matched = after, matched + 1
            yield i, state, matched

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie inside an occurrence of a window, and the items that have those windows."""
        hit, found = np.zeros(len(words) + 1, np.int64), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start < self.least:
                continue
            for i, state, matched in self.walk(ids[start:end].tolist()):
                if matched >= self.window:
                    at = state
                    while self.length[self.link[at]] >= self.window:
                        at = self.link[at]
                    found.update(self.long_items[at])
                    hit[start + i + 1 - self.window] += 1
                    hit[start + i + 1] -= 1
                for n, item in self.short_items.get(state, ()):
                    if n <= matched:
                        found.add(item)
                        hit[start + i + 1 - n] += 1
                        hit[start + i + 1] -= 1
        for k in found & self.alike.keys():
            found.update(self.alike[k])
        return hit[:-1].cumsum() > 0, found


def automata(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK):
    """One Automaton for each ``block`` words of items, in turn."""
    items, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text")
    for name, text in rows.toLocalIterator():
        words = alnum_words(text.encode() if text is not None else None)
        if items and n + len(words) > block:
            yield Automaton.of(items, window)
            items, n = [], 0
        items.append((name, words))
        n += len(words)
    yield Automaton.of(items, window)


_HITS = (
    StructField("n_words", LongType()), StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())),
    StructField("items", ArrayType(StringType())),
)


def _spans(a: Automaton, texts: list[bytes | None]) -> tuple[list, list, list, list]:
    """Of each text: words, starts and ends of the spans of hit words, items hit."""
    n_words, starts, ends, items = [], [], [], []
    for text in texts:
        words = alnum_words(text)
        hit, found = a.matches(words)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
        n_words.append(len(words))
        starts.append(edges[::2])
        ends.append(edges[1::2])
        items.append([a.items[k] for k in found])
    return n_words, starts, ends, items


def _hits(rows: DataFrame, keep: str, automaton) -> DataFrame:
    """Column ``keep`` of ``rows`` with n_words, the spans of hit words (word positions) and the items hit, by one automaton."""

    def run(batches):
        a = automaton.value
        for b in batches:
            n_words, starts, ends, items = _spans(a, utf8(b.column(1)))
            made = [pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], [keep, "n_words", "starts", "ends", "items"])

    return map_texts(rows.select(keep, "text"), run, StructType([rows.schema[keep], *_HITS]))


def _merge(spans: pd.Series) -> pd.DataFrame:
    """Sorted, disjoint spans (starts, ends) from each row's array of (start, end)."""
    starts, ends = [], []
    for row in spans:
        s, e = [], []
        for a, b in sorted((x["start"], x["end"]) for x in row):
            if s and a <= e[-1]:
                e[-1] = max(e[-1], b)
            else:
                s.append(a)
                e.append(b)
        starts.append(s)
        ends.append(e)
    return pd.DataFrame({"starts": starts, "ends": ends})


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Each row of ``docs`` as a struct ``doc`` beside n_words, ``starts`` and ``ends`` (the disjoint spans
    of words inside any occurrence of an item's window, ascending) and ``items`` (the distinct ids, as
    text, of the items whose windows occur, sorted).

    Words are lower-cased runs of letters and digits. A window is ``window`` consecutive words of an item
    or, if it has fewer but some, all of them. Null and blank texts have no words; items with none have
    no window. An item with a null id marks words and counts as an item with the empty id. Repeated
    rows and items change nothing.
    """
    return _contamination(docs, automata(benchmark, window, block))


def _contamination(docs: DataFrame, every) -> DataFrame:
    """``contamination`` by ``every`` automaton in turn, so that no task and no driver holds more than one.

    With several, each reads the documents and writes the key and the spans of those it hits, nothing of the others and no
    text. The finds of a document are put together in the end. The table of them stays with the result.
    """
    spark = docs.sparkSession
    first, second = next(every), next(every, None)
    if second is None:
        rows = docs.select(F.struct(*columns(docs)).alias("doc"), F.col("text").alias("text"))
        found = _hits(rows, "doc", spark.sparkContext.broadcast(first))
        return found.withColumn("items", _names(F.col("items")))
    passes = []
    for a in chain((first, second), every):
        sent = spark.sparkContext.broadcast(a)
        keyed = docs.select(F.struct(*row_key(docs)).alias("key"), "text")
        hit = _hits(keyed, "key", sent).filter(F.size("starts") > 0).select("key.*", "starts", "ends", "items")
        passes.append(written(hit.dropDuplicates(["doc_id", "_th"]), "decontam-pass"))
        sent.destroy()
    spans = F.flatten(F.collect_list(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))))
    each = reduce(DataFrame.unionAll, passes).groupBy("doc_id", "_th").agg(spans.alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    merged = F.pandas_udf(_merge, StructType([StructField(c, ArrayType(IntegerType())) for c in ("starts", "ends")]))
    each = written(each.select("doc_id", "_th", merged("spans").alias("m"), _names(F.col("items")).alias("items")), "decontam-found")
    drop_written(spark, *passes)
    rows = docs.select(F.struct(*columns(docs)).alias("doc"), F.xxhash64("text").alias("_h"))
    out = rows.join(each, F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("_th")), "left")
    none = F.array().cast("array<int>")
    n_words = F.coalesce(F.regexp_count("doc.text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    return out.select("doc", n_words.alias("n_words"), F.coalesce("m.starts", none).alias("starts"), F.coalesce("m.ends", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _names(items: Column) -> Column:
    """Distinct names, sorted; a null one is the empty name."""
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: F.coalesce(x, F.lit("")))))


def digest(found: DataFrame) -> DataFrame:
    """One row a document: counts of words, hit words and items, and a hash of the items' names."""
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut_spans(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span, and a space in their place."""
    blank = np.frombuffer(text.translate(ALNUM_TABLE), np.uint8) == 32
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(text[at : edges[2 * a]])
        at = edges[2 * b - 1]
    out.append(text[at:])
    return b" ".join(out)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = 400, coverage: float = 0.5, block: int = BLOCK) -> DataFrame:
    """``docs`` without benchmark passages; all columns stay and ``n_chars``, if there is one, is counted anew.

    Spans of hit words are cut out of the text. A document goes as a whole if a span is longer than
    ``most`` words or more than ``coverage`` of its words are hit. Documents without a hit stay as they are,
    so do null and blank texts and each repeated row. No items cut nothing; no rows give no rows.
    """
    names, every = docs.columns, automata(benchmark, window, block)
    first, second = next(every), next(every, None)
    at = names.index("text")

    def cut(fields: list, n_words: list, starts: list, ends: list) -> pa.RecordBatch:
        texts, keep = utf8(fields[at]), []
        for k, (n, s, e) in enumerate(zip(n_words, starts, ends)):
            longest, hit = max((y - x for x, y in zip(s, e)), default=0), sum(e) - sum(s)
            keep.append(longest <= most and hit <= coverage * max(n, 1))
            if s and keep[-1]:
                texts[k] = cut_spans(texts[k], s, e)
        fields[at] = pa.array(texts, pa.binary()).cast(pa.string())
        if "n_chars" in names:
            was, changed = fields[names.index("n_chars")], pa.array([bool(s) for s in starts], pa.bool_())
            now = pc.utf8_length(fields[at]).cast(was.type)
            fields[names.index("n_chars")] = pc.if_else(changed, now, was)
        return pa.RecordBatch.from_arrays(fields, names).filter(pa.array(keep, pa.bool_()))

    def once(batches):  # one automaton: marked and cut by the same worker
        for b in batches:
            fields = b.column(0).flatten()
            yield cut(fields, *_spans(sent.value, utf8(fields[at]))[:3])

    def after(batches):
        for b in batches:
            yield cut(b.column(0).flatten(), *(b.column(k).to_pylist() for k in (1, 2, 3)))

    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)
        return map_texts(docs.select(F.struct(*columns(docs)).alias("doc")), once, docs.schema)
    return map_texts(_contamination(docs, chain((first, second), every)), after, docs.schema)
