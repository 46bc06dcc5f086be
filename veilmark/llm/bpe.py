"""Encoding and decoding of a byte-level BPE by guessing and checking.

A list of tokens is the encoding of its bytes if every token is the encoding of its own bytes and every two
neighbours are: no merge across the border between them would come before the merges that made them. So:

1. Guess. All places of all new pre-tokens look up the longest token that starts there at once, in a tree
   of the tokens that encode to themselves; each pre-token is walked greedily from its start.
2. Check. All distinct pairs of neighbours are taken apart together, the later merge of the two sides
   first. At each step the two symbols at the border must have no merge that would have come earlier than
   the merge just undone.
3. Only pre-tokens with a pair that fails are merged exactly, lowest rank first.

Texts are then put together from the arrays of their pre-tokens' ids.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import columns, map_texts, utf8
from .tandem import parts, ragged
from .tokencount import Counter

#: Entries of a worker's cache; it starts anew when full.
CACHE = 300_000
_NEVER = np.int64(1 << 40)
#: Pre-tokens that are walked together in arrays; fewer are walked one by one.
TOGETHER = 16
#: Bytes of a pre-token that is merged together with others; longer ones are merged by a heap.
SHORT = 48


class Table:
    """Ids of strings, in one array; ``number`` has the place of each string."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys))))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))

    def get(self, keys, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``keys`` one after another, and where those of each group of ``many`` keys begin and end."""
        at = np.fromiter(map(self.number.__getitem__, keys), np.int64, many.sum())
        start = self.ends[at]
        sizes = self.ends[at + 1] - start
        return self.ids[ragged(start, sizes)], np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(many))]


class Codec:
    """Encodes and decodes as the tokenizer file at ``path`` does."""

    def __init__(self, path: str):
        base = Counter(path)
        self.pattern, self.loose, self.keys, self.ranks, self.of_byte = base.pattern, base.loose, base.keys, base.ranks, base.of_byte
        self.of_rank = made = base.made
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges of the vocabulary make one token")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(names)})" if names else "((?!))")
        top = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        texts: list[bytes | None] = [None] * top  # of each token
        for value, token in enumerate(self.of_byte.tolist()):
            texts[token] = bytes([value])
        self.left, self.right, self.rank = np.zeros(top, np.int64), np.zeros(top, np.int64), np.full(top, -1)
        self.pair_rank: dict[int, int] = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        by_rank = np.empty(len(made), np.int64)
        by_rank[self.ranks] = self.keys
        left, right = by_rank >> 32, by_rank & 0xFFFFFFFF
        self.left[made], self.right[made], self.rank[made] = left, right, np.arange(len(made))
        # a token encodes to itself if both parts do and nothing but its own merge joins them
        own = self.rank < 0
        alone = self.compatible(left, right, parts_of_one=True)
        for token, a, b, fine in zip(made.tolist(), left.tolist(), right.tolist(), alone.tolist()):
            texts[token] = texts[a] + texts[b]
            own[token] = fine and own[a] and own[b]
        self._plant([t for t in range(top) if texts[t] is not None and own[t]], texts)
        for text, token in self.special.items():
            texts[token] = text.encode()
        # bytes of the tokens one after another, of nothing behind the last
        self.sizes = np.array([*[len(t or b"") for t in texts], 0], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join([t or b"" for t in texts]), np.uint8)
        self._forget()

    def _plant(self, tokens: list[int], bytes_of: list[bytes]) -> None:
        """The tree of the tokens' bytes: node k + 1 lies behind ``edges[k]`` (parent * 256 + byte), ``token[node]`` ends there."""
        texts = [bytes_of[t] for t in tokens]
        ids, sizes = np.array(tokens), np.array([len(t) for t in texts])
        flat, starts = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64), np.cumsum(sizes) - sizes
        node, edges, ends = np.zeros(len(ids), np.int64), [], [np.array([-1])]
        for depth in range(sizes.max()):
            here = np.flatnonzero(sizes > depth)
            found, at = np.unique(node[here] * 256 + flat[starts[here] + depth], return_inverse=True)
            node[here] = at + 1 + sum(map(len, edges))
            edges.append(found)
            last = np.full(len(found), -1)
            done = sizes[here] == depth + 1
            last[at[done]] = ids[here[done]]
            ends.append(last)
        self.edges, self.token = np.concatenate(edges), np.concatenate(ends)

    def _forget(self) -> None:
        """An empty cache."""
        self.pieces, self.chunks = Table(), Table()
        self.chunks.add(list(self.special), np.array(list(self.special.values()), np.int64), np.ones(len(self.special), np.int64))

    def _merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, _NEVER if there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, parts_of_one: bool = False) -> np.ndarray:
        """Whether the encoding of two tokens' bytes together is the two tokens. ``parts_of_one``: the merge of the two
        themselves is allowed."""
        fine = np.ones(len(left), bool)
        at, u, v = np.arange(len(left)), left, right
        # rank of the merge that ends each symbol's time at the border; of two equal ones the left comes first
        until_u, until_v = np.full(len(left), _NEVER), np.full(len(left), _NEVER)
        first = parts_of_one
        while len(at):
            merge = self._merges(u, v)
            bad = (merge < until_u) & (merge <= until_v) & (merge < _NEVER) & (not first)
            first = False
            fine[at[bad]] = False
            ru, rv = self.rank[u], self.rank[v]
            go = ~bad & ((ru >= 0) | (rv >= 0))
            undo = ru > rv
            until_u, until_v = np.where(undo, ru, until_u)[go], np.where(undo, until_v, rv)[go]
            u, v, at = np.where(undo, self.right[u], u)[go], np.where(undo, v, self.left[v])[go], at[go]
        return fine

    def longest(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, size) of the longest token that starts at each place and ends before ``ends``."""
        token, size = np.full(len(flat), -1), np.zeros(len(flat), np.int64)
        at, node, depth = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0
        while len(at):
            key = node * 256 + flat[at + depth]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            there = self.edges[edge] == key
            at, node, depth = at[there], edge[there] + 1, depth + 1
            ended = self.token[node] >= 0
            token[at[ended]], size[at[ended]] = self.token[node[ended]], depth
            more = at + depth < ends[at]
            at, node = at[more], node[more]
        return token, size

    def guess(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy tokens of all nonempty pieces, and the piece of each token."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat, ends = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.cumsum(sizes)
        token, size = self.longest(flat, np.repeat(ends, sizes))
        taken, cur, stop = np.zeros(len(flat), bool), ends - sizes, ends
        while len(cur) >= TOGETHER:
            taken[cur] = True
            cur = cur + size[cur]
            more = cur < stop
            cur, stop = cur[more], stop[more]
        for a, b in zip(cur.tolist(), stop.tolist()):
            steps, x = size[a:b].tolist(), 0
            while x < b - a:
                taken[a + x] = True
                x += steps[x]
        return token[taken], np.repeat(np.arange(len(pieces)), sizes)[taken]

    def exact(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each nonempty piece by merging: all short pieces at once, each its pair of lowest rank a round."""
        out = [None if len(p) <= SHORT else self.merged(p) for p in pieces]
        rest = [k for k, ids in enumerate(out) if ids is None]
        sizes = np.array([len(pieces[k]) for k in rest], np.int64)
        flat, alive = self.of_byte[np.frombuffer(b"".join([pieces[k] for k in rest]), np.uint8)], np.array(rest, np.int64)
        while len(flat):
            starts = np.cumsum(sizes) - sizes
            rank = np.append(self._merges(flat[:-1], flat[1:]), _NEVER)
            rank[starts + sizes - 1] = _NEVER
            least = np.minimum.reduceat(rank, starts)
            over = np.flatnonzero(least == _NEVER)
            for k, a, n in zip(alive[over].tolist(), starts[over].tolist(), sizes[over].tolist()):
                out[k] = flat[a : a + n]
            # the leftmost of the lowest, one a piece: no two of them touch
            hit = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < _NEVER))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])[: len(hit)]]
            keep = least[owner] < _NEVER
            keep[hit + 1] = False
            flat = flat.copy()
            flat[hit] = self.of_rank[rank[hit]]
            sizes[least < _NEVER] -= 1
            flat, sizes, alive = flat[keep], sizes[least < _NEVER], alive[least < _NEVER]
        return out

    def merged(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length: a heap of the pairs by rank, the left of equals first."""
        ids, of_rank = self.of_byte[np.frombuffer(piece, np.uint8)].tolist(), self.of_rank.tolist()
        n, rank = len(ids), self.pair_rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank.get((ids[i] << 32) | ids[j]) != r:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = of_rank[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get((ids[i] << 32) | ids[k])) is not None:
                    heapq.heappush(heap, (s, i))
            h = before[i]
            if h >= 0 and (s := rank.get((ids[h] << 32) | ids[i])) is not None:
                heapq.heappush(heap, (s, h))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the nonempty pre-tokens one after another, and how many each has."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens, piece = self.guess(pieces)
        same = np.flatnonzero(piece[1:] == piece[:-1])
        pairs, at = np.unique((tokens[same] << 32) | tokens[same + 1], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[at]
        wrong = np.unique(piece[same[bad]])
        mended = self.exact([pieces[k] for k in wrong.tolist()])
        keep = ~np.isin(piece, wrong)
        owner = np.concatenate((piece[keep], np.repeat(wrong, [len(x) for x in mended])))
        order = np.argsort(owner, kind="stable")
        return np.concatenate((tokens[keep], *mended))[order], np.bincount(owner, minlength=len(pieces))

    def _chunks(self, text: str) -> list[str]:
        """Stretches of ``text`` that are pre-tokenised alike alone, and its special tokens."""
        out = []
        for part in self.cut.split(text) if self.cut.search(text) else (text,):
            if not part:
                continue
            if part in self.special or part[-1] == " " or part[0] == " " or self.loose.search(part):
                out.append(part)
            else:  # each space is alone between two words and starts a pre-token of its own
                first, *rest = part.split(" ")
                out.append(first)
                out.extend([" " + x for x in rest])
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts): ids of all texts one after another, those of text k from cuts[k] to cuts[k + 1]; null has none."""
        if len(self.chunks.number) > CACHE or len(self.pieces.number) > CACHE:
            self._forget()
        split = [self._chunks(t.decode()) if t else [] for t in texts]
        new = list(set(chain.from_iterable(split)) - self.chunks.number.keys())
        # a space and ASCII letters are one pre-token
        found = [(c,) if c.isascii() and c[1:].isalpha() and c[0] == " " else self.pattern.findall(c) for c in new]
        pieces = list(set(chain.from_iterable(found)) - self.pieces.number.keys())
        self.pieces.add(pieces, *self.encode_pieces([p.encode() for p in pieces]))
        many = np.fromiter(map(len, found), np.int64, len(found))
        ids, cuts = self.pieces.get(chain.from_iterable(found), many)
        self.chunks.add(new, ids, np.diff(cuts))
        return self.chunks.get(chain.from_iterable(split), np.fromiter(map(len, split), np.int64, len(split)))

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The text of each stretch of ``ids``; ids that the vocabulary has not are left out, bytes that are no UTF-8
        become U+FFFD."""
        known = np.where((ids >= 0) & (ids < len(self.sizes)), ids, len(self.sizes) - 1)
        sizes = self.sizes[known]
        data = self.data[ragged(self.starts[known], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[cuts].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    """This worker's codec for ``path``; workers live longer than tasks."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, vocabulary: str, decode: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids (array of int) and, with ``decode``, the text that ``decoded`` makes of
    them, by the same worker.

    ``vocabulary`` is a tokenizers JSON file of a byte-level BPE that every worker can open. Whole texts are encoded,
    without begin, end or padding tokens; special strings in a text are the one token they are to the library. Null and
    empty texts have no ids and decode to an empty text. Repeated rows get the same ids; other columns are not read.
    """

    def run(batches):
        codec = _codec(vocabulary)
        for batch in batches:
            for part in parts(batch, 1):
                ids, cuts = codec.encode(utf8(part.column(1)))
                made = [part.column(0), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))]
                if decode:
                    made.append(pa.array(codec.decode(ids, cuts), pa.string()))
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "ids", "text"][: len(made)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>" + ", text string" * decode)


def decoded(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with a column ``text`` (a column of that name is replaced): the text of the array of token ids in column
    ``ids``. Null ids give null, no ids an empty text; ids that the vocabulary has not, and null ones, are left out."""
    kept = [f for f in rows.schema.fields if f.name.lower() != text.lower()]
    at = [f.name for f in kept].index(ids)
    # names of their own while in Python, as mapInArrow takes no names with dots
    plain = [StructField(f"c{k}", f.dataType) for k, f in enumerate([*kept, StructField(text, StringType())])]

    def run(batches):
        codec = _codec(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                given = [None if x is None else [i for i in x if i is not None] for x in part.column(at).to_pylist()]
                flat = np.fromiter(chain.from_iterable(x or () for x in given), np.int64)
                cuts = np.append(0, np.cumsum([len(x or ()) for x in given]))
                texts = [None if x is None else t for x, t in zip(given, codec.decode(flat, cuts))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [f.name for f in plain])

    held = [c for c, f in zip(columns(rows), rows.schema.fields) if f.name.lower() != text.lower()]
    source = rows.select(*[c.alias(f.name) for c, f in zip(held, plain)])
    return map_texts(source, run, StructType(plain)).toDF(*[f.name for f in kept], text)
