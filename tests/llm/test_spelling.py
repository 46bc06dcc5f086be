"""Spelling variants against a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import documents

from veilmark.llm import queries, spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(counts, often=3, factor=2):
    n = {w: c for w, c in counts.items() if c >= often and len(w) >= 5}
    form, many = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        many[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return Counter((w, form[w], root(w), n[w], many[w], n.get(form[w])) for w in n)


def planted(doc_id, run):
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if doc_id is not None and h % 97 == 0 else run


def counted(rows, edit=lambda i, w: w):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            out[edit(doc_id, "".join(c.lower() if c.isascii() else c for c in run))] += 1
    return out


def some_texts(rng, n):
    stems = ["".join(rng.choice("abé×") for _ in range(rng.randrange(4, 9))) for _ in range(12)]
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(30)):
            w = rng.choice(stems)
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w, w, w, w[:i] + rng.choice("abÉ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abz") + w[i + 1 :], w.upper()])
            words.append(w)
        yield rng.choice([" ", ", ", "1", "\n"]).join(words)


def test_words_and_their_forms(spark):
    rows = [*enumerate(some_texts(random.Random(1), 300)), (900, None), (None, "aaaaa aaaab"), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(map(tuple, spelling.variants(docs).collect()))
    assert got == grouped(counted(rows)) and len(got) > 200
    assert max(x[4] for x in got) > 3 and any(x[1] != x[2] for x in got if x[1])
    assert Counter(map(tuple, spelling.variants(docs, often=10, factor=5).collect())) == grouped(counted(rows), 10, 5)


def test_long_and_repeated_letters(spark):
    long = "x" * 60_000
    rows = [(k, f"{long} {long}x {long[:-1]}y aaaaaa aaaaa aaaaaaa") for k in range(3)] + [(9, long), (10, "aaaaaa " * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.word: r for r in spelling.variants(docs, factor=2).collect()}
    assert len(got) == 6 and got[long].n_near == 2 and got[long + "x"].n_near == 1 and got[long[:-1] + "y"].n_near == 1
    assert got["aaaaa"].root == got["aaaaaaa"].root == "aaaaaa" and got["aaaaaa"].n_near == 2 and got["aaaaaa"].form is None


def test_chains_of_forms(spark):
    letters = "abcdefgh"
    chain = [letters[:k] + "zzzzzzzz"[k:] for k in range(9)]  # each one letter from the next
    docs = spark.createDataFrame([(k, (w + " ") * (3 * 2**k)) for k, w in enumerate(chain)], "doc_id bigint, text string")
    assert {r.root for r in spelling.variants(docs).collect()} == {chain[-1]}


def test_colliding_keys_link_nothing(spark, monkeypatch):
    rows = [*enumerate(some_texts(random.Random(2), 100))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = spark.createDataFrame([(k, w, n) for k, (w, n) in enumerate(counted(rows).items()) if n >= 3 and len(w) >= 5], "id bigint, word string, n bigint")
    keys = spelling._keys(words).selectExpr("key % 7 as key", "id", "at")
    got = spelling._near(spelling._shared(keys).join(words, "id")).groupBy("id").sum("near")
    want = {r.word: r.n_near for r in spelling.variants(docs).collect() if r.n_near}
    assert {r.word: r[1] for r in got.join(words, "id").select("word", "sum(near)").collect()} == want


def test_keys_name_strings():
    rng = random.Random(3)
    words = ["".join(rng.choice("abÿ") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    key, owner, at = spelling.keys_of(words)
    strings = {}
    for k, o, a in zip(key.tolist(), owner.tolist(), at.tolist()):
        w = words[o]
        string = (w[:a] + w[a + 1 :], a) if a >= 0 else (w, None) if a == -1 else (w[: -2 - a] + w[-1 - a :], None)
        assert strings.setdefault(k, string) == string
    assert len(set(strings.values())) == len(strings)
    assert np.array_equal(spelling.keys_of(words[5:6])[0], key[owner == 5])


def test_query_against_all_pairs(spark, tmp_path):
    docs = documents(spark, [*some_texts(random.Random(4), 400), None, "", "one", None])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = counted(rows, planted)
    assert want != counted(rows)
    assert Counter(map(tuple, queries.spelling_variants(spark, str(tmp_path)).collect())) == grouped(want)


def test_awkward_tables(spark):
    docs = documents(spark)
    out = spelling.variants(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() > 0
    assert spelling.variants(docs.limit(0)).collect() == [] and spelling.variants(docs.filter("text is null")).collect() == []
    with pytest.raises(ValueError, match="circles"):
        spelling.variants(docs, factor=1)
