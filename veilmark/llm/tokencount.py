"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch are held as one flat array of symbol ids with the number of the sequence
each belongs to. A step looks up the rank of every adjacent pair, finds each sequence's lowest rank and
merges all its occurrences, for all sequences at once; sequences without a rank left are done and their
symbols are counted. Merges made by a rank only make pairs of higher rank, so this gives the library's
result. Counts of pre-tokens are kept in a bounded cache.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, utf8

#: Entries of a worker's cache; it starts anew when full.
CACHE = 400_000
_NONE = np.int64(1 << 40)
#: The published pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts tokens as the tokenizer file at ``path`` does."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.of_byte = np.array([vocabulary[c] for c in _byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.pattern = regex.compile(PATTERN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.loose = regex.compile(r" \s|\s ")
        self.chunks: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that are left of each nonempty piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        flat, alive = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], np.arange(len(pieces))
        while len(flat):
            starts = np.cumsum(sizes) - sizes
            last = starts + sizes - 1
            key = (flat << 32) | np.concatenate((flat[1:], [0]))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], _NONE)
            rank[last] = _NONE
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            hit = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < _NONE))
            if len(hit):  # of overlapping occurrences (a a a) take every other one, from the left
                begin = np.concatenate(([True], np.diff(hit) != 1))
                run = np.cumsum(begin) - 1
                hit = hit[(hit - hit[np.flatnonzero(begin)][run]) % 2 == 0]
            flat[hit] = self.made[rank[hit]]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            owner = np.repeat(np.arange(len(sizes)), sizes)
            out[alive[done]] = sizes[done]
            keep &= ~done[owner]
            sizes = np.bincount(owner[keep], minlength=len(sizes))[~done]
            flat, alive = flat[keep], alive[~done]
        return out

    def _split(self, text: str) -> tuple[list[str], int]:
        """Chunks of ``text`` that are pre-tokenised alike alone, and the special tokens in it."""
        n, parts = 0, [text]
        if self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        out = []
        for part in parts:
            if not part:
                continue
            if part[-1] == " " or part[0] == " " or self.loose.search(part):
                out.append(part)
            else:  # each space is alone between two words and starts a pre-token of its own
                first, *rest = part.split(" ")
                out.append(first)
                out.extend([" " + x for x in rest])
        return out, n

    def count(self, texts: list[bytes | None]) -> list[int]:
        """Tokens of each text; null has none."""
        if len(self.chunks) > CACHE:
            self.chunks = {}
        if len(self.pieces) > CACHE:
            self.pieces = {}
        split = [self._split(t.decode()) if t else ([], 0) for t in texts]
        new = list(set().union(*(c for c, _ in split)) - self.chunks.keys())
        found = [self.pattern.findall(c) for c in new]
        pieces = list(set().union(*found) - self.pieces.keys())
        self.pieces.update(zip(pieces, self.merged([p.encode() for p in pieces]).tolist()))
        for c, f in zip(new, found):
            self.chunks[c] = sum(map(self.pieces.__getitem__, f))
        return [n + sum(map(self.chunks.__getitem__, c)) for c, n in split]


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """This worker's counter for ``path``; workers live longer than tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``vocabulary`` is a tokenizers JSON file of a byte-level BPE that every worker can open. Whole texts
    are counted, without begin, end or padding tokens; special strings in a text count as the one token
    they are to the library. Null and empty texts have none. Repeated rows count alike.
    """

    def run(batches):
        counter = _counter(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = utf8(part.column(1))
                made = [pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
