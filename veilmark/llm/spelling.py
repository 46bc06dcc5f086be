"""Spelling variants of the words of a corpus: words one letter apart, found by keys of rolling hashes.

Two words are near if one letter inserted, deleted or replaced turns one into the other. Then they have a
string in common: what is left of both without the replaced letter, or of the longer one without the
inserted letter. Its hash follows from hashes of what stands before and behind the letter, so that the
keys of all letters of a batch of words come from one running sum modulo 2^64. The keys, with numbers in
place of the words, are dealt out by their value and sorted; keys of one word only are dropped there. Where
a key is shared, the strings themselves are compared, so that a collision of hashes links nothing.

No pairs are listed: of all words that share a string the number and the two most frequent say what each
of them needs to know.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, map_texts, utf8, written
from .tandem import parts, ragged

#: Runs of letters: ASCII and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: Words that a task counts before it hands them on.
HELD = 200_000
#: Keys in one batch on their way out of a worker.
OUT = 500_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)

Edit = Callable[[int | None], Callable[[str], str]]


def word_counts(docs: DataFrame, least: int = 5, edit: Edit | None = None) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, of ``least`` code points at least, and how often each stands there.

    ``edit``: for a doc_id a function of a lower-cased run to the word that counts in its place; it is asked once for each
    distinct run of a document.
    """
    rx = re.compile(f"[{LETTERS}]{{{least},}}")  # shorter runs stay shorter

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in parts(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                    if not text:
                        continue
                    runs = rx.findall(text.lower().decode())
                    if edit is None:
                        held.update(runs)
                        continue
                    change = edit(doc_id)
                    for word, n in Counter(runs).items():
                        word = change(word)
                        if len(word) >= least:
                            held[word] += n
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        yield out()

    return map_texts(docs.select("doc_id", "text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the word, at) of all strings by which ``words`` can be near another: at the word without letter
    ``at`` where one is replaced there; at -1 the word itself; at -2 - i the word without letter i (the first of equal neighbours)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n, ends = len(codes), np.cumsum(sizes)
    power = np.ones(n + 2, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(n + 1, _BASE, np.uint64))
    back = np.ones(n + 2, np.uint64)
    back[1:] = np.multiply.accumulate(np.full(n + 1, _BACK, np.uint64))
    sums = np.append(np.uint64(0), np.cumsum((codes + np.uint64(1)) * power[:n]))
    starts = ends - sizes
    owner, here = np.repeat(np.arange(len(words)), sizes), np.arange(n)
    s, e = starts[owner], ends[owner]
    before = (sums[here] - sums[s]) * back[s]  # the hash of what stands before each letter
    behind = (sums[e] - sums[here + 1]) * back[s + 1]  # and behind it, one place further left
    without, whole = before + behind, (sums[ends] - sums[starts]) * back[starts]
    first = np.append(True, codes[1:] != codes[:-1])[:n] | (here == s)
    at = here - s
    return (
        np.concatenate((_mixed(without, sizes[owner] - 1, at + 1), _mixed(whole, sizes, 0), _mixed(without[first], sizes[owner[first]] - 1, 0))).view(np.int64),
        np.concatenate((owner, np.arange(len(words)), owner[first])),
        np.concatenate((at, np.full(len(words), -1), -2 - at[first])),
    )


def _mixed(h: np.ndarray, size: np.ndarray, place) -> np.ndarray:
    """The hash of a string with its length and, where it counts, the place of the letter that is gone."""
    h = h + np.asarray(size, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.asarray(place, np.uint64) * np.uint64(0x165667B19E3779F9)
    for k, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(k))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _keys(words: DataFrame) -> DataFrame:
    """(key, id, at) of every word of (id, word)."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1, rows=20_000, size=OUT // 2):
                if not part.num_rows:
                    continue
                key, owner, at = keys_of(part.column(1).to_pylist())
                ids = part.column(0).to_numpy()[owner]
                for k in range(0, len(key), OUT):
                    made = [pa.array(x[k : k + OUT], kind) for x, kind in ((key, pa.int64()), (ids, pa.int64()), (at, pa.int32()))]
                    yield pa.RecordBatch.from_arrays(made, ["key", "id", "at"])

    return words.select("id", "word").mapInArrow(run, "key bigint, id bigint, at int")


def _whole_groups(batches):
    """Batches of rows sorted by their first column, cut so that none divides a group."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        key = rest.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None:
        yield rest


def _shared(keys: DataFrame) -> DataFrame:
    """The rows whose key another word has in a way that may make them near."""

    def run(batches):
        for batch in _whole_groups(batches):
            key, at = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
            many = lambda rows: np.bincount(group[rows], minlength=group[-1] + 1)[group]  # noqa: B023, E731
            replaced, own, longer = at >= 0, at == -1, at < -1
            keep = (replaced & (many(replaced) > 1)) | (own & (many(longer) > 0)) | (longer & (many(own) > 0))
            yield batch.filter(pa.array(keep))

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, keys.schema)


def _found(members: list[tuple[int, str, int]]):
    """(id, how many others, n and word of the best other) of each of the words that are near one another."""
    best = nsmallest(2, members, key=lambda m: (-m[2], m[1]))
    for i, word, _ in members:
        other = best[1] if word == best[0][1] else best[0]
        yield i, len(members) - 1, -other[2], other[1]


def _near(rows: DataFrame) -> DataFrame:
    """(id, near, minus_n, best) for each group of words near one another by one string: rows (key, at, id, word, n)."""

    def run(batches):
        for batch in _whole_groups(batches):
            out, groups = [], defaultdict(list)
            own: dict[tuple[int, str], tuple] = {}
            for key, at, i, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if at >= 0:  # the strings themselves decide
                    groups[key, at, word[:at] + word[at + 1 :]].append((i, word, n))
                elif at == -1:
                    own[key, word] = (i, word, n)
                else:
                    groups[key, -1, word[: -2 - at] + word[-1 - at :]].append((i, word, n))
            for (key, at, string), members in groups.items():
                if at >= 0 and len(members) > 1:
                    out.extend(_found(members))
                elif at < 0 and (key, string) in own:
                    i, word, n = own[key, string]
                    top = min(members, key=lambda m: (-m[2], m[1]))
                    out.append((i, len(members), -top[2], top[1]))
                    out.extend((j, 1, -n, word) for j, _, _ in members)
            made = zip(*out) if out else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(made, kinds)], ["id", "near", "minus_n", "best"])

    dealt = rows.select("key", "at", "id", "word", "n").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "id bigint, near bigint, minus_n bigint, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow from each word of (word, form); forms have no circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = written(step, "spelling-roots")
        drop_written(forms.sparkSession, now)
        now = after.drop("moved")
        if after.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = 5, often: int = 3, factor: int = 2, edit: Edit | None = None) -> DataFrame:
    """One row for each word of ``docs``: word, form, root, n, n_near, form_n.

    Words are runs of letters, A-Z lower-cased, of ``least`` code points at least that stand ``often`` times in all texts.
    n_near: how many other words are one inserted, deleted or replaced code point away. form: the one of these with the
    largest n (ties: the smallest in code-point order), if it stands at least ``factor`` times as often as the word, and
    form_n its n; else null. root: the last of the forms that follow from a word, the word itself if it has none.
    ``edit``: see ``word_counts``. Null and empty texts have no words, repeated rows count as often as they come; other
    columns are not read. A table without words gives no rows.

    Tables in the shared folder (words, shared keys, roots) are deleted but for those that the result reads.
    """
    if factor < 2:
        raise ValueError("forms could go round in circles")
    counted = word_counts(docs, least, edit).filter(F.col("n") >= often)
    words = written(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    shared = written(_shared(_keys(words)), "spelling-keys")
    near = _near(shared.join(words, "id")).groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus_n", "best")).alias("top"))
    best = -F.col("top.minus_n")
    formed = best >= factor * F.col("n")
    rows = words.join(near, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("top.best")).alias("form"), F.when(formed, best).alias("form_n")
    )
    judged = written(rows, "spelling-near")
    drop_written(docs.sparkSession, shared, words)
    roots = _roots(judged.filter("form is not null"))
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
