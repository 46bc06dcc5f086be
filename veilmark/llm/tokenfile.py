"""Token ids in ORC files, sorted by document id.

ORC keeps integers run-length encoded in stripes that are read in parallel; every stripe has row
indexes with the range of ``doc_id`` in each group of rows, and a Bloom filter on it, so a reader that
asks for some documents skips the stripes and row groups without them. ``ids`` of a row are the
document's tokens and the end id.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, partitions_for, scratch, small_batches, utf8, written

END_ID = 2
#: Distinct pieces that a worker keeps; beyond them it starts anew.
CACHE = 500_000
#: Bytes of text that are cut into pieces at once, if no single text is longer.
CHUNK = 8 << 20
#: Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 what is never cut from its neighbours: a
#: non-ASCII character may go with either side, and an apostrophe may begin a contraction.
_KIND = bytes(
    0 if c == 32 or 9 <= c <= 13 else 1 if 65 <= c <= 90 or 97 <= c <= 122 else 2 if 48 <= c <= 57 else 4 if c >= 128 or c == 39 else 3
    for c in range(256)
)
_BLANKS = b" \t\n\x0b\x0c\r"


def _cut(before: int, after: int) -> bool:
    """Whether a piece ends between bytes of two kinds, neither of them white space."""
    return 4 not in (before, after) and (before != after or after == 2)


_STARTS = bytes(((k & 7) > 0 and (k >> 3 == 0 or _cut(k >> 3, k & 7))) for k in range(256))
_ENDS = bytes((k >> 3 > 0 and (k & 7 == 0 or _cut(k >> 3, k & 7))) for k in range(256))
#: First bytes of the combining marks that ASCII letters are composed with: there, lower-casing letters
#: first may give another composition.
_MARKS = re.compile(rb"[\xcc\xcd]")
#: A chunk that may hold a special token, which is a matter of case and never cut.
_SPECIAL = re.compile(rb"[^ \t-\r]*<\|[^ \t-\r]*")
#: Pieces that normalising leaves as they are and that are one pre-token.
_PLAIN = re.compile(rb"[a-z]+|[0-9]|(?!.*<\|)[!-&(-/:-@\[-`{-~]+")
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def pieces(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all ``texts``, one after another, and where each text's begin (and the last one's end).

    A piece ends at white space and between ASCII characters of different kinds or two digits: there a
    pre-token of the tokenizer ends for sure. ASCII letters are lower-cased, but for pieces with combining
    marks and chunks that may hold special tokens. White space is dropped, so that pieces lie end to end.
    """
    raw = b"\n".join([b"", *(t or b"" for t in texts), b""])
    low = raw.lower()
    kind = np.frombuffer(raw.translate(_KIND), np.uint8)
    step = ((kind[:-1] << 3) | kind[1:]).tobytes()
    begins, stops = (np.frombuffer(step.translate(t), bool) for t in (_STARTS, _ENDS))
    if b"<|" in raw:
        begins, stops, low = begins.copy(), stops.copy(), bytearray(low)
        for m in _SPECIAL.finditer(raw):
            begins[m.start() : m.end() - 1] = stops[m.start() : m.end() - 1] = False
            low[m.start() : m.end()] = m[0]
    starts, ends = np.flatnonzero(begins) + 1, np.flatnonzero(stops) + 1
    if marks := [m.start() for m in _MARKS.finditer(raw)]:
        low = bytearray(low)
        for k in np.unique(np.searchsorted(starts, marks, side="right") - 1).tolist():
            low[starts[k] : ends[k]] = raw[starts[k] : ends[k]]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    data = pa.py_buffer(bytes(low.translate(None, _BLANKS)))
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), data])
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    return found, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))


class PieceEncoder:
    """Ids of whole texts, by way of their distinct pieces.

    The tokenizer lower-cases, drops white space and merges nothing across its pre-tokens, so a text's
    ids are those of its ``pieces`` one after another, and each distinct piece is encoded by the library
    once. Ids of all pieces stand in one flat array; a text's are gathered from it. Many pieces go to the
    library as one text: one of plain ASCII is one pre-token, which ends with its one token that has the
    end-of-word mark, and needs no normalising but is split at blanks only; between others, which may hold
    several pre-tokens, stands a separator.
    """

    SEPARATOR = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[k for x, k in names.items() if x.endswith("</w>")]] = True
        ((self.mark,),) = self._ids(self.tokenizer, [self.SEPARATOR])
        self.forget()

    def forget(self) -> None:
        """Start anew."""
        self.at, self.flat, self.bounds = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, new: list[bytes], flat: np.ndarray, ends: np.ndarray) -> None:
        """Keep new pieces, whose ids are ``flat`` up to ``ends``."""
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + ends))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def _learn_words(self, new: list[bytes]) -> None:
        """Encode new pieces of printable ASCII, many to a text."""
        groups = [b" ".join(new[k : k + 32]).decode() for k in range(0, len(new), 32)]
        ids = np.array([x for g in self._ids(self.plain, groups) for x in g], np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the tokenizer does not take pieces one by one")
        self._add(new, ids, ends)

    def _learn_others(self, new: list[bytes]) -> None:
        """Encode new pieces without special tokens and separators, many to a text."""
        glue = f" {self.SEPARATOR} "
        groups = [glue.join(p.decode() for p in new[k : k + 32]) + glue for k in range(0, len(new), 32)]
        ids = np.array([x for g in self._ids(self.tokenizer, groups) for x in g], np.int64)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(new):
            raise ValueError("the tokenizer does not take pieces one by one")
        self._add(new, np.delete(ids, marks), marks - np.arange(len(marks)))

    def encode(self, texts: list[bytes | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, each followed by ``end_id`` unless it is None, and each text's bounds."""
        if len(self.at) > CACHE:
            self.forget()
        found, bounds = pieces(texts)
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.array([self.at.get(p, -1) for p in distinct], np.int64)
        if len(missing := np.flatnonzero(place < 0)):
            new = [distinct[k] for k in missing.tolist()]
            words = list(filter(_PLAIN.fullmatch, new))
            others = list(set(new).difference(words))
            odd = {p for p in others if b"\x01" in p or b"<|" in p}
            self._learn_words(words)
            self._learn_others([p for p in others if p not in odd])
            for p in odd:
                (ids,) = self._ids(self.tokenizer, [p.decode()])
                self._add([p], np.array(ids, np.int64), np.array([len(ids)]))
            place[missing] = [self.at[p] for p in new]
        place = place[coded.indices.to_numpy()]
        first, size = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        last = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(last[-1]) + np.repeat(first - last[:-1], size)]
        bounds = last[bounds]
        if end_id is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def _encoder(path: str):
    """This worker's encoder for ``path``; workers live longer than tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


_ENCODERS: dict[str, PieceEncoder] = {}


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Encode every whole text of ``docs`` (null: empty), append ``end_id`` and write (doc_id, ids) as ORC
    files to ``path``, in ascending doc_id order through all files (null first; ties by text)."""

    def run(batches):
        encoder = _encoder(vocabulary)

        def done(ids, texts):
            found, bounds = encoder.encode(texts, end_id)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), lists], ["doc_id", "ids"])

        ids, texts, held = [], [], 0
        for b in batches:
            begin = 0
            for at, text in enumerate(utf8(b.column(1)), 1):
                texts.append(text)
                held += len(text or b"")
                if held > CHUNK or at == b.num_rows:
                    ids.append(b.column(0).slice(begin, at - begin))
                    begin = at
                if held > CHUNK:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
        if texts:
            yield done(ids, texts)

    n = files or partitions_for(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    with small_batches(docs.sparkSession):  # the ids of a batch stand beside its texts
        map_texts(rows, run, f"doc_id {kind}, ids array<int>").write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str, where: Column | None = None, id_type: str = "bigint") -> DataFrame:
    """(doc_id, ids) of the files; ``where`` on doc_id is pushed down to stripes and row groups."""
    rows = spark.read.schema(f"doc_id {id_type}, ids array<int>").orc(path)
    return rows if where is None else rows.filter(where)


def index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Per row of the files: doc_id, start (ids in all rows before it), n_tokens and ids_crc32 (unsigned
    crc32 of its ids as little-endian unsigned 32-bit integers), read back from them.

    Files are in order, so a row's start is its file's start, a running sum over one number for each
    file, plus the running sum within its file.
    """

    def run(batches):
        for b in batches:
            ids = b.column(2)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            o = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:z]) for a, z in zip(o[:-1].tolist(), o[1:].tolist())]
            made = [pa.array(np.diff(o), pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *made], ["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    files = read(spark, path, id_type=id_type)
    kind = id_type
    name = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    rows = files.select(name.alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("row"), "ids", "doc_id")
    rows = map_texts(rows.select("file", F.struct("_at", "row").alias("row"), "ids", "doc_id"), run, f"file int, row struct<_at bigint, row bigint>, doc_id {kind}, n_tokens bigint, ids_crc32 bigint"
    )
    with small_batches(spark):
        rows = written(rows, "token-index")  # three numbers a row, read twice below
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("_start", within).join(before, "file").select(
        "doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenised(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token files (to a new shared folder unless ``path`` is given) and return their index.

    Null and blank texts have the end id only. A null doc_id sorts first. Repeated rows are written as
    often as they come. No rows give no rows.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    write(docs, path, vocabulary, end_id)
    return index(spark, path, docs.schema["doc_id"].dataType.simpleString())
