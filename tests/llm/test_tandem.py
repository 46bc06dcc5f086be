"""Periodic runs against a search over all periods."""

import hashlib
import random
import time
import zlib
from collections import Counter

from cases import documents

from veilmark.llm import queries, tandem
from veilmark.llm.common import space_words


def brute(words, least=6, exponent=4):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            repeats = lambda p: all(words[x] == words[x + p] for x in range(i, i + size - p))  # noqa: B023, E731
            if size >= max(least, exponent * q) and size >= 2 * q and not any(map(repeats, range(1, q))):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_documents(rng, n):
    for _ in range(n):
        size, vocabulary = rng.randrange(60), rng.choice([1, 2, 3, 5, 50])
        words = [b"w%d" % rng.randrange(vocabulary) for _ in range(size)]
        if size and rng.random() < 0.5:
            a = rng.randrange(size)
            p = 1 + rng.randrange((size - a) // 3 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(size)]
        yield words


def test_runs_of_many_small_documents():
    docs = list(some_documents(random.Random(5), 800))
    for least, exponent in ((6, 4), (2, 2), (3, 3), (6, 2), (1, 5)):
        for document, got in zip(docs, tandem.document_runs(docs, least, exponent)):
            assert [tuple(r) for r in got.tolist()] == brute(document, least, exponent)


def test_batches_do_not_matter():
    docs = list(some_documents(random.Random(6), 200))
    alone = [tandem.document_runs([d])[0].tolist() for d in docs]
    assert [x.tolist() for x in tandem.document_runs(docs)] == alone


def test_runs_within_runs_and_long_texts():
    inner = [b"a", b"a", b"a", b"a", b"a", b"a", b"b"]
    assert [tuple(r) for r in tandem.document_runs([inner * 5])[0].tolist()] == brute(inner * 5)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 100_000:  # a Fibonacci word has squares everywhere and no fourth power
        a, b = b, b + a
    began = time.time()
    assert len(tandem.document_runs([b])[0]) == 0
    assert tandem.document_runs([[b"x"] * 200_000])[0].tolist() == [[0, 200_000, 1]]
    assert tandem.document_runs([[b"w%d" % (i % 20_000) for i in range(100_000)]])[0].tolist() == [[0, 100_000, 20_000]]
    assert time.time() - began < 60


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, space_words(None if text is None else text.encode()))
    found = brute(words)
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    digest = sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode())
    rest = sha(b" ".join(w for i, w in enumerate(words) if i not in gone))
    return doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, rest


def test_query_against_brute_force(spark, tmp_path):
    docs = documents(spark).filter("coalesce(length(text), 0) < 10000")
    many = docs.unionByName(spark.range(200, 400).selectExpr("id as doc_id", "array_join(transform(sequence(1, 1 + id % 90), x -> cast(x * x % (3 + id % 11) as string)), ' ') as text"), allowMissingColumns=True)
    many.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.periodic_runs(spark, str(tmp_path)).collect()
    want = [expected(r.doc_id, r.text) for r in many.collect()]
    assert Counter(map(tuple, rows)) == Counter(want)
    assert sum(r.n_runs > 0 for r in rows) > 50


def test_operator_columns_and_empty_tables(spark):
    docs = documents(spark)
    out = tandem.periodic_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and rows[4].n_words == 0 and rows[4].runs == [] and rows[4].collapsed == ""
    assert rows[11].runs[0][1:] == (200, 1) and rows[11].collapsed == "same"
    assert tandem.periodic_runs(docs.limit(0)).collect() == []
