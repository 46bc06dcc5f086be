"""The codec against the tokenizers library."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilmark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def same(codec, library, texts):
    ids, cuts = codec.encode([t.encode() for t in texts])
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want
    assert codec.decode(ids, cuts) == [library.decode(x, skip_special_tokens=False) for x in want] == texts


def test_texts_of_every_kind(codec, library):
    rng = random.Random(3)
    letters = [*"aaabbceetthi   \n\t'sé日🙂1234.,!?-_  ", "<|endoftext|>", "<|end", "the", "ing", " the", "tion", "'ll", " "]
    same(codec, library, ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)])
    same(codec, library, ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "", " ", "\n"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(codec, library, texts):
    same(codec, library, texts)


def test_long_pre_tokens_in_bounded_time(codec, library):
    rng = random.Random(4)
    began = time.time()
    same(codec, library, ["a" * 100_000, " " * 50_000, "ab" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(200_000))])
    assert time.time() - began < 60


def test_pairs_are_judged_as_merging_does(codec):
    rng = np.random.default_rng(5)
    own = codec.token[codec.token >= 0]
    left, right = rng.choice(own, 20_000), rng.choice(own, 20_000)
    text = lambda t: codec.data[codec.starts[t] : codec.starts[t] + codec.sizes[t]].tobytes()
    together = [codec.merged(text(a) + text(b)).tolist() == [a, b] for a, b in zip(left, right)]
    assert codec.compatible(left, right).tolist() == together and 0 < sum(together) < len(together)
    assert all(codec.merged(text(t)).tolist() == [t] for t in own[:5000])


def test_rounds_and_heap_merge_alike(codec):
    rng = random.Random(6)
    pieces = [bytes(rng.choice(b"abcdeinorst \xc3\xa9") for _ in range(rng.randrange(1, bpe.SHORT))) for _ in range(3000)]
    assert [x.tolist() for x in codec.exact(pieces)] == [codec.merged(p).tolist() for p in pieces]


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    own, rng = bpe.Codec(PATH), random.Random(7)
    for _ in range(5):
        same(own, library, [" ".join(f"w{rng.randrange(100)}x" for _ in range(40)) for _ in range(5)])


def test_query_against_the_library(spark, tmp_path, library):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in queries.bpe_round_trip(spark, str(tmp_path)).collect()]
    want, sha = [], lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert Counter(rows) == Counter(want)


def test_operators_alone(spark, library):
    docs = documents(spark)
    ids = bpe.encoded(docs, PATH)
    assert ids.columns == ["doc_id", "ids"] and bpe.encoded(docs.limit(0), PATH).collect() == []
    back = bpe.decoded(ids.withColumnsRenamed({"doc_id": "a.b"}), PATH)
    assert Counter((r["a.b"], r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    odd = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, [64, None, 99_999_999, -1, 65, 172], "x")], "k int, ids array<int>, `Text` string")
    assert [tuple(r) for r in bpe.decoded(odd, PATH).select("k", "text").orderBy("k").collect()] == [(1, None), (2, ""), (3, library.decode([64, 65, 172], skip_special_tokens=False))]
