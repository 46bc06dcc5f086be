"""Near duplicates by Jaccard similarity against brute force over all pairs."""

import random

import pytest
from cases import documents, words

import corpus_pipeline
from veilmark.llm import similar


def brute(rows, width=5, least=0.8):
    """Of (doc_id, text) rows, the ids that stay."""

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 5 * least * len(sets[a] | sets[b]) - 1e-9:
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted(min(g) for g in groups.values())


def changed(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base, chain = [words(rng, 200) for _ in range(12)], [words(rng, 150)]
    for _ in range(30):  # each like the one before, the ends unlike
        chain.append(changed(rng, chain[-1], 2))
    near = [changed(rng, t, n) for t in base for n in (1, 2, 3, 4, 5, 6, 8)]
    line = words(rng, 30)
    return base + near + chain + [line + " " + words(rng, n) for n in range(1, 30)] + [None, "", " ", "one", "One", "a b c"]


@pytest.mark.parametrize("bucket", [1, 8])
def test_keeps_one_of_each_group_as_brute_force_does(spark, texts, bucket):
    got = similar.keep_one(documents(spark, texts), bucket=bucket).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == brute(list(enumerate(texts)))


def test_pipeline_stage_drops_near_copies_of_many_differing_bits(spark, texts):
    got = corpus_pipeline.no_near_copies(spark, documents(spark, texts), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == brute(list(enumerate(texts)))
