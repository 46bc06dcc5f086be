"""Tables that grow with the corpus are joined by shuffles and never sent whole through the driver."""

import random

import pytest
from cases import documents, words

from veilmark.llm import common, simhash


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written."""
    seen, real = [], common.written

    def written(df, tag):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, tag)

    monkeypatch.setattr(common, "written", written)
    monkeypatch.setattr(simhash, "written", written)
    return seen


def test_simhash_broadcasts_nothing(spark, plans, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    rng = random.Random(3)
    texts = [words(rng, 60) for _ in range(10)]
    df = documents(spark, texts + [t + " " + t.split()[0] for t in texts] + texts[:3])
    out = [simhash.near_duplicates(df), simhash.keep_one(df)]
    for plan in plans + [x._jdf.queryExecution().executedPlan().toString() for x in out]:
        assert "Broadcast" not in plan
    assert [x.count() for x in out][0] == 23 and any("SortMergeJoin" in p for p in plans)


def test_components_broadcast_nothing(spark, plans):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}
    assert plans and not any("Broadcast" in p for p in plans)
