"""Exact percentiles against the built-in one."""

import random

import pytest
from pyspark.sql import functions as F

from veilmark.operators import quantiles

SHARES = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]


def both(df, **options):
    got = {r.g: (r.n, r.cuts) for r in quantiles.exact_percentiles(df, ["g"], "v", SHARES, **options).collect()}
    plain = df.filter("v is not null").groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", F.array(*[F.lit(q) for q in SHARES])).alias("cuts"))
    return got, {r.g: (r.n, r.cuts) for r in plain.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for g in want:
        assert got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1], nan_ok=True)


@pytest.mark.parametrize("options", [{}, {"accuracy": 100, "most": 100}])
def test_groups_of_any_size(spark, options):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, rng.gauss(0, 1), float(rng.randrange(5))])) for g, n in (("one", 1), ("two", 2), ("few", 41), ("some", 3000), ("many", 20_000)) for _ in range(n)]
    rows += [("same", 7.0)] * 5000 + [("none", None), (None, 1.0), (None, 2.0), ("ends", -1e300), ("ends", 1e300), ("nan", float("nan")), ("nan", 1.0)]
    same(*both(spark.createDataFrame(rows, "g string, v double").repartition(4), **options))


def test_bounds_are_drawn_closer(spark):
    df = spark.range(20_000).selectExpr("'g' as g", "(id * 7919 % 20000) * 0.5 as v")
    same(*both(df, accuracy=20, most=500))
    assert quantiles.exact_percentiles(df.limit(0), ["g"], "v", SHARES).collect() == []
