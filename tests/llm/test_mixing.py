"""First fit beyond the first rows behind a misfit, against the query's SQL."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilmark.llm import mixing, oracles


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    rng = np.random.default_rng(0)
    n = 60_000
    size = np.maximum(rng.lognormal(4, 1.2, n).astype(int), 2)
    size[rng.random(n) < 0.0005] = 1  # rare documents of one word, which fit what nothing else does
    size[rng.random(n) < 0.001] = 0
    path = tmp_path_factory.mktemp("mix") / "documents.parquet"
    pd.DataFrame({"doc_id": np.arange(n), "text": ["a " * k for k in size], "source": rng.choice(["s0", "s1", "s2", "s3"], n, p=[0.4, 0.3, 0.2, 0.1])}).to_parquet(path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    return str(path), Counter(con.sql(oracles.source_mix()).fetchall())


@pytest.mark.parametrize("pool", [4096, 64])
def test_first_fit_tries_every_document(spark, table, pool, monkeypatch):
    path, want = table
    monkeypatch.setattr(mixing.plan, "__defaults__", (*mixing.plan.__defaults__[:-1], pool))
    got = mixing.mix(spark.read.parquet(path)).select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    assert Counter(map(tuple, got.collect())) == want


def test_columns_with_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5, 6), (2, None, None, 7, 8)], "doc_id bigint, text string, source string, `a.b` int, `_cut` int")
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and {r["a.b"] for r in out.collect()} <= {5, 7}
    assert mixing.repeated(docs.limit(0)).count() == 0
