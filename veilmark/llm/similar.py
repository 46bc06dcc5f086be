"""Near duplicates by the Jaccard similarity of word shingles: every pair at or above a similarity.

A set of n shingles that is similar to t or more to another one shares all but n - ceil(t n) of them, so
first sets are left out that share too few shingles with all other sets together. For that the shingles
whose hashes lie in the lowest part (``COUNTED``) are counted over the whole corpus; what a set may lack
among them is bounded by what it may lack at all, so no set with a partner goes. Equal sets are folded.

Of the sets that stay, those of a pair share one of the first n - ceil(t n) + 1 shingles of each, in any
order that all sets agree on: from the rarest to the most frequent. An equality join on those prefixes
finds every pair. Parities of shingle classes bound how far two sets differ and settle most of the pairs
found; the rest are checked on the whole sets.

A prefix shingle of more than ``BUCKET`` sets is not joined with itself at once. Its sets are compared with
``LEADERS`` of them, and once what these link is known, only sets that are still apart are
compared pairwise: a large group of near copies costs linear work, and no pair that could join two groups is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dealt, drop_written, map_texts, release, row_key, utf8, written
from .simhash import majority, near_pairs, one_each, shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
#: Prefix shingles of up to this many sets are joined pairwise at once.
BUCKET = 8
LEADERS = 3
#: Classes of frequent shingles with leaders of their own.
DRAWS = 8
#: Of so many first shingles of two sets a common one shows that the pair is found there.
HEAD = 8
#: Part of the hash space whose shingles are counted. Above 1 - SIMILARITY it can leave sets out.
COUNTED = 0.4
#: Bytes of text whose counted shingles make one group (about a million of them).
GROUP = 20_000_000
#: Up to so many keys of sets are sent to every task; more are joined.
SENT = 300_000
_BYTES = 6  # of a hash, in the rows that are counted


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted set of each text's shingles."""
    return [np.unique(shingle_hashes(t, width)) for t in utf8(texts)]


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), pa.int64()))


def _low(counted: float) -> np.uint64:
    """Shingles up to this hash are counted."""
    return np.uint64(int(counted * (1 << 64)) - 1)


def nodes(docs: DataFrame, width: int, counted: float, simhash: int | None = None) -> DataFrame:
    """(doc_id, _th, node, n, low, fp): each row's key, a hash of its set of shingles, how many it has and how
    many of them are counted, and its SimHash fingerprint of ``simhash``-word shingles (null without them)."""

    def run(batches):
        for b in batches:
            sets = _sets(b.column(2), width)
            made = [pa.array(np.array([_node(s) for s in sets], np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int32())]
            low = pa.array([int(np.searchsorted(s, _low(counted), side="right")) for s in sets], pa.int32())
            fps = [None if simhash is None else majority(shingle_hashes(t, simhash)) for t in utf8(b.column(2))]
            fps = pa.array([None if f is None else f - (f >> 63 << 64) for f in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *made, low, fps], ["doc_id", "_th", "node", "n", "low", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select(*row_key(docs), "text"), run, f"doc_id {kind}, _th bigint, node bigint, n int, low int, fp bigint")


def _packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    return out.view("<u8").reshape(-1).astype(np.uint64)


_SHORT = np.uint64((1 << 8 * _BYTES) - 1)


def _counted_rows(docs: DataFrame, width: int, counted: float, groups: int) -> DataFrame:
    """(part, shingles, sets, counts): the counted shingles of many sets at once, by group. A shingle that
    three or more sets of a batch hold is shared for sure: it is sent for two of them, and for the others
    only how many such they have (in rows of negative part), so that no group grows with a frequent one."""

    def run(batches):
        for b in batches:
            sets = {_node(s): s[: np.searchsorted(s, _low(counted), side="right")] for s in _sets(b.column(0), width)}
            names = np.array(list(sets), np.uint64)
            flat = np.concatenate([*sets.values(), np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(names)), [len(s) for s in sets.values()])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            first = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
            at = np.flatnonzero(first)
            rank = np.arange(len(flat)) - np.repeat(at, np.diff(np.append(at, len(flat))))
            known = np.bincount(owner[rank > 1], minlength=len(names))
            flat, owner = flat[rank < 2], owner[rank < 2]
            part = (flat % np.uint64(groups)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, flat, owner = part[order], flat[order], owner[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, np.int64)
            rows = [(int(part[x]), _packed(flat[x:y] >> np.uint64(64 - 8 * _BYTES)), _packed(names[owner[x:y]]), b"") for x, y in zip(edges[:-1], edges[1:])]
            if known.any():
                some = np.flatnonzero(known)
                rows.append((-1 - int(names[some[0]] % np.uint64(groups)), b"", _packed(names[some]), known[some].astype("<i4").tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            for k in range(0, len(rows), 200):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 200]), kinds)], ["part", "shingles", "sets", "counts"])

    return map_texts(docs.select("text"), run, "part bigint, shingles binary, sets binary, counts binary")


def _shared_counts(rows: DataFrame, groups: int) -> DataFrame:
    """(short, c): for sets, by the low bits of their node, how many of their counted shingles other sets
    have. Each group of shingles is settled by itself; its counts are sent on packed, by groups of sets."""

    def packed(names: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        to = (names % np.uint64(groups)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, names, counts = to[order], names[order], counts[order].astype("<i4")
        edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1)) if len(to) else np.zeros(1, np.int64)
        made = [(int(to[x]), _packed(names[x:y]), counts[x:y].tobytes()) for x, y in zip(edges[:-1], edges[1:])]
        columns = zip(*made) if made else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["part", "sets", "counts"])

    def settle(held: list) -> pa.RecordBatch:
        shingle, name = (np.concatenate([_unpacked(x) for x in column]) for column in zip(*held))
        order = np.lexsort((name, shingle))
        shingle, name = shingle[order], name[order]
        fresh = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1])))
        shingle, name = shingle[fresh], name[fresh]
        like = shingle[1:] == shingle[:-1]
        shared = np.concatenate((like, [False])) | np.concatenate(([False], like))
        return packed(*np.unique(name[shared], return_counts=True))

    def count(batches):
        now, held = None, []
        for b in batches:
            for part, *of, counts in zip(*(c.to_pylist() for c in b.columns)):
                if part < 0:
                    yield packed(_unpacked(of[1]), np.frombuffer(counts, "<i4"))
                    continue
                if part != now and held:
                    yield settle(held)
                    held = []
                now = part
                held.append(of)
        if held:
            yield settle(held)

    def summed(held: list) -> pa.RecordBatch:
        names, at = np.unique(np.concatenate([_unpacked(x) for x, _ in held]), return_inverse=True)
        c = np.bincount(at, np.concatenate([np.frombuffer(x, "<i4") for _, x in held]), len(names))
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(c.astype(np.int64))], ["short", "c"])

    def add(batches):
        now, held = None, []
        for b in batches:
            for part, *of in zip(*(c.to_pylist() for c in b.columns)):
                if part != now and held:
                    yield summed(held)
                    held = []
                now = part
                held.append(of)
        if held:
            yield summed(held)

    found = rows.repartition("part").sortWithinPartitions("part").mapInArrow(count, "part bigint, sets binary, counts binary")
    return found.repartition("part").sortWithinPartitions("part").mapInArrow(add, "short bigint, c bigint")


def _lacking(n: Column, similarity: float) -> Column:
    """How many of its n shingles a set may not share with a similar one."""
    return n - F.ceil(similarity * n - 1e-9)


def partnered(docs: DataFrame, rows: DataFrame, width: int, similarity: float, counted: float, group: int) -> DataFrame:
    """(node, n, doc_id, _th) of the sets that share enough shingles with other sets to have a partner, and
    the key of one row of each."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    groups = size // group + 1
    shared = _shared_counts(_counted_rows(docs, width, counted, groups), groups)
    one = rows.filter("n > 0").groupBy("node", "n", "low").agg(F.min(F.struct("_th", "doc_id")).alias("k"))
    both = one.join(shared, one["node"].bitwiseAND(F.lit(int(_SHORT))) == shared["short"], "left")
    enough = F.coalesce("c", F.lit(0)) >= F.col("low") - _lacking(F.col("n"), similarity)
    return both.filter(enough).select("node", "n", "k.doc_id", "k._th")


def _parities(shingles: np.ndarray, classes: int) -> np.ndarray:
    odd = np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def whole_sets(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(node, n, bits, few, shingles) of ``keys`` (node, doc_id, _th): bits are the parities of a set's shingles
    dealt into classes, a power of two of them that is at least its size; few are those of 256 classes at most."""

    def run(batches):
        for b in batches:
            sets = _sets(b.column(1), width)
            classes = [max(64, 1 << (len(s) - 1).bit_length()) for s in sets]
            bits, few = ([_parities(s, min(c, most)) for s, c in zip(sets, classes)] for most in (1 << 40, 256))
            made = [pa.array([len(s) for s in sets], pa.int32()), _lists(bits), _lists(few), _lists([s.view(np.int64) for s in sets])]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["node", "n", "bits", "few", "shingles"])

    if keys.count() <= SENT:  # checked: three numbers each
        keys = F.broadcast(keys)
    texts = docs.select(*row_key(docs), "text").alias("d").join(keys.alias("k"), F.expr("d._th = k._th and d.doc_id <=> k.doc_id"))
    # rows that repeat id and text have equal sets
    found = map_texts(texts.select("k.node", "d.text"), run, "node bigint, n int, bits array<bigint>, few array<bigint>, shingles array<bigint>")
    return found


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(s, node, n, i): of each set the first shingles, rarest first, and their places; those of one set aside."""
    each = sets.select("node", "n", F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    # written before the join, which then deals both sides out anew and can split a frequent shingle
    counts = written(counts, "similar-counts")
    shared = each.join(counts, "s")
    # shingles of one set come first in the order and need no place but a number
    alone = Window.partitionBy("node").orderBy("f", "s")
    placed = shared.withColumn("k", F.row_number().over(alone)).withColumn("of", F.count("*").over(Window.partitionBy("node")))
    placed = placed.withColumn("i", (F.col("n") - F.col("of") + F.col("k") - 1).cast("int"))
    return placed.filter(F.col("i") <= _lacking(F.col("n"), similarity)).select("s", "node", "n", "i"), counts


def _possible(similarity: float) -> str:
    """Whether sets a and b, whose prefixes share a shingle at places i, can still be similar enough: by
    their sizes, and by the shingles that are left from there on."""
    return (
        f"least(a.n, b.n) >= {similarity} * greatest(a.n, b.n) - 1e-9 and "
        f"least(a.n - a.i, b.n - b.i) * (1 + {similarity}) >= {similarity} * (a.n + b.n) - 1e-9"
    )


def _odd(a: str, b: str) -> Column:
    """In how many classes the parities ``a`` and ``b`` differ; the longer one is folded to the shorter's classes."""
    # classes are the low bits of a hash: the halves of a bitmap are folded on one another
    half = lambda x: f"zip_with(slice({x}, 1, cast(size({x}) / 2 as int)), slice({x}, cast(size({x}) / 2 as int) + 1, cast(size({x}) / 2 as int)), (x, y) -> x ^ y)"
    folded = lambda x, y: f"case when size({x}) > size({y}) then {half(x)} else {x} end"
    return F.expr(f"aggregate(zip_with({folded(a, b)}, {folded(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) whose sets are similar enough.

    Classes of odd count in one set only are at most the shingles in one set only: pairs with too many
    go before whole sets are compared.
    """
    spark = sets.sparkSession
    side = lambda x, *cs: sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in cs])
    likely = pairs.join(side("u", "n", "bits"), "u").join(side("v", "n", "bits"), "v")
    likely = likely.filter((F.col("u_n") + F.col("v_n") - _odd("u_bits", "v_bits")) / 2 * (1 + similarity) >= similarity * (F.col("u_n") + F.col("v_n")) - 1e-9)
    likely = written(likely.select("u", "v"), "similar-likely")
    release(spark)
    both = likely.join(side("u", "n", "shingles"), "u").join(side("v", "n", "shingles"), "v")
    shared = F.size(F.array_intersect("u_shingles", "v_shingles"))
    edges = both.filter(shared * (1 + similarity) >= similarity * (F.col("u_n") + F.col("v_n")) - 1e-9).select("u", "v")
    edges = written(edges, "similar-edges")
    drop_written(spark, likely)
    release(spark)
    return edges


def similar_roots(sets: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """(node, root) of the ``whole_sets`` that are similar enough to another one, directly or through others."""
    spark = sets.sparkSession
    placed, rare = prefixes(sets, similarity)
    placed = written(placed, "similar-places")
    drop_written(spark, rare)
    release(spark)
    counts = written(placed.groupBy("s").agg(F.count("*").alias("held")).filter("held > 1"), "similar-held")
    shared = written(placed.join(counts, "s"), "similar-buckets")
    drop_written(spark, placed, counts)
    release(spark)
    possible = _possible(similarity)
    some = shared.filter(F.col("held") <= bucket)
    pairs = some.alias("a").join(some.alias("b"), F.expr(f"a.s = b.s and a.node > b.node and {possible}")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    hot = shared.filter(F.col("held") > bucket)
    pairs = written(pairs.union(_led(hot, similarity)).distinct(), "similar-pairs")
    release(spark)
    edges = _verified(pairs, sets, similarity)
    drop_written(spark, pairs)
    roots = written(components(edges), "similar-linked")
    # all pairs of what is still apart, each once or nearly so: not where both hold an earlier shingle as well
    head = shared.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("i", "s"))), 1, HEAD).alias("head"))
    left = written(_apart(hot, roots).join(sets.select("node", "few"), "node").join(head, "node"), "similar-apart")
    near = (F.col("a.n") + F.col("b.n") - _odd("a.few", "b.few")) / 2 * (1 + similarity) >= similarity * (F.col("a.n") + F.col("b.n")) - 1e-9
    rest = left.alias("a").join(left.alias("b"), F.expr(f"a.s = b.s and a.node > b.node and a.root <> b.root and {possible} and not exists(a.head, x -> x.i < a.i and exists(b.head, y -> y.s = x.s))") & near)
    rest = written(rest.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct(), "similar-rest")
    drop_written(spark, shared, left)
    release(spark)
    if rest.isEmpty():
        return roots
    more = _verified(rest, sets, similarity)
    return roots if more.isEmpty() else components(edges.union(more))


def _led(hot: DataFrame, similarity: float) -> DataFrame:
    """(u, v): each set of a frequent shingle with the ``LEADERS`` of the shingle and about its own size.
    Shingles of ``DRAWS`` classes draw them anew, so that a set that holds many of them meets many leaders."""
    hot = hot.withColumn("of", F.floor(F.log("n") / F.log(F.lit(1 / similarity))).cast("int"))  # similar sets are a class apart at most
    key = lambda k: F.struct(F.xxhash64("node", F.pmod("s", F.lit(DRAWS)), F.lit(k)).alias("h"), "node", "n", "i")
    leaders = hot.groupBy("s", "of").agg(F.array_distinct(F.array(*[F.min(key(k)) for k in range(LEADERS)])).alias("l"))
    leaders = leaders.select("s", "of", F.explode("l").alias("l")).select("s", F.explode(F.array(*[F.col("of") + k for k in (-1, 0, 1)])).alias("of"), "l.node", "l.n", "l.i")
    met = hot.alias("a").join(leaders.alias("b"), F.expr(f"a.s = b.s and a.of = b.of and a.node <> b.node and {_possible(similarity)}"))
    return met.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"))


def _apart(hot: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``hot`` whose shingle is held by sets that are not linked yet, with the sets' roots."""
    left = hot.join(roots, "node", "left").select("s", "node", "n", "i", F.coalesce("root", "node").alias("root"))
    apart = left.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("s")
    return left.join(apart, "s")


def fingerprint_links(rows: DataFrame) -> DataFrame:
    """(u, v): links among the sets of ``rows`` (node, fp) whose texts' fingerprints are two bits apart at most, directly or through
    others: each set with the smallest of its group."""
    prints = written(rows.select("node", "fp").distinct(), "simhash-prints")
    roots = components(near_pairs(prints.select("fp").distinct())).select(F.col("node").alias("fp"), F.col("root").alias("of"))
    held = written(prints.join(dealt(roots), "fp", "left").select("node", F.coalesce("of", "fp").alias("of")).distinct(), "simhash-held")
    least = held.groupBy("of").agg(F.min("node").alias("v"))
    links = written(held.join(dealt(least), "of").filter("node <> v").select(F.col("node").alias("u"), "v"), "simhash-links")
    drop_written(rows.sparkSession, prints, held)
    return links


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bucket: int = BUCKET, counted: float = COUNTED, group: int = GROUP, simhash: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of documents that are linked by a Jaccard similarity of their
    sets of ``width``-word shingles of ``similarity`` or more: the one with the smallest doc_id, a row
    without an id only where its group has no other. All columns stay. Null and blank texts have no
    words and are one group; of repeated rows one stays; no rows give no rows. ``bucket``, ``counted`` and
    ``group`` change the work, not the result. With ``simhash``, texts whose SimHash fingerprints of so many words a shingle differ
    in at most two bits are linked as well, and groups are those of both kinds of links.
    """
    spark = docs.sparkSession
    rows = written(nodes(docs, width, counted, simhash), "similar-rows")
    keys = written(partnered(docs, rows, width, similarity, counted, group), "similar-keys")
    release(spark)
    sets = written(whole_sets(docs, keys.select("node", "doc_id", "_th"), width), "similar-sets")
    sets = _one_a_node(sets, keys)
    roots = similar_roots(sets, similarity, bucket)
    if simhash is not None:
        roots = components(fingerprint_links(rows).union(roots.select("node", "root")))
        release(spark)
    prints = rows.select("doc_id", "_th", F.col("node").alias("fp"))
    rooted = prints.select("fp").distinct().join(dealt(roots), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "similar-roots")
    drop_written(spark, keys, sets)
    release(spark)
    return one_each(docs, prints, rooted)


def _one_a_node(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """``sets`` with one row a node: rows that repeat id and text gave theirs more than once."""
    return sets if sets.count() == keys.count() else written(sets.dropDuplicates(["node"]), "similar-sets")
