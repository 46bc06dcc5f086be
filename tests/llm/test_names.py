"""Columns of any name stay as they are; empty tables and long texts go through every filtering operator."""

import os

import pytest
from pyspark.sql import functions as F

from cases import texts
from veilmark.llm import common, decontam, mixing, quality, simhash, similar

SCHEMA = "doc_id bigint, text string, source string, `a.b` string, `_th` string, `__row_th` string, node string, `c d` string"


@pytest.fixture(scope="module")
def tables(spark):
    long = " ".join(f"w{k * k % 9973}" for k in range(200_000))
    every = [*texts(), long, long + " end", "y" * 1_000_000]
    docs = spark.createDataFrame([(k, t, f"s{k % 3}", "ab", "th", "row", "n", "t") for k, t in enumerate(every)], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(k, " ".join(long.split()[50 * k : 50 * k + 30])) for k in range(6)] + [(9, None), (0, "w1")], "item_id bigint, text string")
    return docs, labels, items


def operators(docs, labels, items):
    return [
        quality.keep_good(docs, labels, threshold=0.0), simhash.keep_one(docs), similar.keep_one(docs), mixing.repeated(docs),
        decontam.decontaminated(docs, items), decontam.decontaminated(docs, items, block=40),
    ]


def test_columns_keep_names_and_values(tables):
    docs = tables[0]
    for out in operators(*tables):
        assert out.columns == docs.columns
        rows = out.drop("text").collect()
        assert len(rows) > 20 and {tuple(r)[2:] for r in rows} == {("ab", "th", "row", "n", "t")}


def test_empty_tables(tables):
    docs, labels, items = tables
    for out in operators(docs.limit(0), labels, items):
        assert out.columns == docs.columns and out.count() == 0


def test_several_automata_cut_what_one_does(tables):
    docs, _, items = tables
    one, many = (decontam.decontaminated(docs, items, block=block).collect() for block in (200_000, 40))
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, many), key=str)


def test_several_automata_mark_what_one_does_and_write_little(tables, monkeypatch):
    docs, _, items = tables
    spark = docs.sparkSession
    plain = lambda df: sorted((r.doc.doc_id, r.n_words, tuple(r.starts), tuple(r.ends), tuple(r["items"])) for r in df.collect())
    twice = docs.union(docs.limit(5)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = twice.filter("doc_id is not null")
    assert plain(decontam.contamination(rows, items, block=40)) == plain(decontam.contamination(rows, items))
    assert decontam.contamination(twice, items, block=40).count() == twice.count()
    many = docs.select("doc_id", "text").filter("length(text) > 100000").crossJoin(spark.range(20)).selectExpr("id as doc_id", "if(id % 10 = 0, text, translate(text, '0123456789', 'abcdefghij')) as text")
    sizes = []

    def noted(df, tag):
        out = common.written(df, tag)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(decontam, "written", noted)
    assert decontam.contamination(many, items, block=40).filter("size(starts) > 0").count() > 0
    assert len(sizes) > 3 and sum(sizes) < 0.05 * many.selectExpr("sum(octet_length(text))").first()[0]


def test_documents_go_by_length_of_a_span_and_coverage(spark):
    item = " ".join(f"i{k}" for k in range(60))
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(1, "a b c " + item), (2, "x " * 200 + item + " y"), (3, "x " * 200 + item[:60]), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = lambda **limits: {r.doc_id: r.text for r in decontam.decontaminated(docs, items, **limits).collect()}
    assert kept().keys() == {2, 3, 4} and "i5" not in kept()[2]
    assert kept(most=50).keys() == {3, 4}
    assert kept(coverage=1.0).keys() == {1, 2, 3, 4}


def test_identical_short_items_all_count():
    a = decontam.Automaton.of([(str(k), [b"w1", b"w2"]) for k in range(500)])
    hit, found = a.matches([b"x", b"w1", b"w2"])
    assert hit.tolist() == [False, True, True] and len(found) == 500 and len(a.short_items) == 1
