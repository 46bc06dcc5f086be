"""Each stage of the pipeline on its own input, and the whole against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, words
from pyspark.sql import functions as F

import corpus_pipeline
from test_similar import brute
from veilmark.llm import decontam, mixing, quality, simhash, similar
from veilmark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(stages):
    assert all(after.columns == before.columns for _, before, after in stages[:4])
    assert [int(n) for n in (len(stages), len(corpus_pipeline.STAGES))] == [5, 5]


def test_each_stage_does_what_its_operator_says(spark, stages):
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(b) == ids(quality.classify(a, labels).filter("predicted = 1"))
    # the stage asks for 5-word shingles of a similarity of 0.8, not for op1's 3 words and 2 bits
    assert sorted(ids(c).elements()) == brute([(r.doc_id, r.text) for r in b.collect()])
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontam.digest(decontam.contamination(c, items)).filter("contaminated").collect()}
    same = {r.doc_id: r.text for r in c.collect() if r.doc_id not in hit}
    assert same.items() <= {r.doc_id: r.text for r in d.collect()}.items()
    assert decontam.digest(decontam.contamination(d, items)).filter("contaminated").count() == 0
    copies = mixing.mix(d).select("doc.doc_id", "copies").collect()
    assert ids(e) == Counter({r.doc_id: r.copies for r in copies if r.copies})
    assert ids(f) == ids(e)
    rows = f.orderBy("start").collect()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_run_is_the_stages_one_after_another(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, stages[-1][2].collect()))


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)] and ORACLE_SQL.keys() <= QUERIES.keys()


def test_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    _, before, after = stages[0]
    good = before.join(labels, "doc_id")
    assert good.join(after.select("doc_id"), "doc_id", "left_semi").count() >= 0.97 * good.count()
    assert after.filter(F.col("text").isNull()).count() == 0


def test_near_copies_go_by_fingerprints_too(spark, monkeypatch):
    # fingerprints link what no pair of shingle sets does: 1 with 2, while shingles link 2 with 3
    rng = random.Random(5)
    a, b, d = (words(rng, 100) for _ in range(3))
    made = {a: 0b1010, b: 0b1001, b + " end": 1 << 40, d: 1 << 20 | 1 << 50}
    monkeypatch.setattr(similar, "majority", lambda hashes: made[next(t for t in made if np.array_equal(hashes, simhash.shingle_hashes(t.encode(), 3)))])
    docs = documents(spark, list(made))
    kept = sorted(r.doc_id for r in corpus_pipeline.no_near_copies(spark, docs, "").select("doc_id").collect())
    assert kept == [0, 3]
    assert sorted(r.doc_id for r in similar.keep_one(docs).select("doc_id").collect()) == [0, 1, 3]


def test_no_two_kept_texts_are_linked_by_fingerprints(spark, stages):
    kept = simhash.near_duplicates(stages[1][2])
    assert kept.count() == kept.select("component_id").distinct().count() > 0
