"""Exact percentiles of groups of any size, in memory that the accuracy sets and not the rows.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here a sketch first says between
which two values each rank lies; the rows below are counted, and only the values between are put in order. Where
too many are between, they are sketched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import first_not_below, let, running_sums


#: Times that bounds are drawn closer.
PASSES = 2


def _at(counts: Column, rank: Column) -> Column:
    """The value of a rank (from 0) among sorted (value, n)."""
    sums = running_sums(F.transform(counts, lambda c: c["n"]))
    return let(sums, lambda s: F.get(counts, first_not_below(s, lambda x: x, rank + 1))["value"])


def _met(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal, with the keys once."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in by else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(other[f"_r_{c}"]) for c in by]
    return left.join(other, on, how).drop(*[f"_r_{c}" for c in by])


def exact_percentiles(rows: DataFrame, by: list[str], column: str, shares: list[float], accuracy: int = 2000, most: int = 50_000) -> DataFrame:
    """(by, n, cuts): the percentiles ``shares`` (0 to 1) of the non-null values of a numeric column, linear between
    neighbouring ranks as ``percentile`` has them. NaN stands above all numbers.

    ``accuracy``: of the sketch, whose error is one in so many rows. ``most``: distinct values between two bounds that are
    put in order together; with more of them the bounds are drawn closer, ``PASSES`` times at most (of a million rows seven are
    left between them by then, unless one value has most rows for itself). Groups without a value are left out.
    """
    value = F.col(column).cast("double")
    given = rows.filter(value.isNotNull()).select(*by, value.alias("_v"))
    near = 3 / accuracy
    marks = sorted({min(1.0, max(0.0, q + d)) for q in shares for d in (-near, near)})
    first = given.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", marks, accuracy).alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_greatest"))
    bounds = []
    for k, q in enumerate(shares):
        low, high = (marks.index(min(1.0, max(0.0, q + d))) for d in (-near, near))
        rank = F.lit(q) * (F.col("n") - 1)
        # in a small group, and at the ends, the margin would be less than the two ranks that are wanted
        whole = F.col("n") <= 2 * accuracy
        least = F.when(whole | F.lit(marks[low] == 0), F.col("_least")).otherwise(F.get("_m", F.lit(low)))
        greatest = F.when(whole | F.lit(marks[high] == 1), F.col("_greatest")).otherwise(F.get("_m", F.lit(high)))
        bounds.append(F.struct(F.lit(k).alias("k"), rank.alias("rank"), least.alias("low"), greatest.alias("high")))
    wanted = first.select(*by, "n", F.inline(F.array(*bounds)))
    for more in reversed(range(PASSES + 1)):
        # rows meet their group's bounds; those outside are counted, those inside by value
        apart = _met(given, wanted, by)
        below = apart.groupBy(*by, "k").agg(F.count_if(F.col("_v") < F.col("low")).alias("below"), F.approx_count_distinct(F.when(F.col("_v").between(F.col("low"), F.col("high")), F.col("_v"))).alias("inside"))
        widest = below.agg(F.coalesce(F.max("inside"), F.lit(0))).first()[0] if more else 0
        if not more or widest <= 1.2 * most:
            break
        wanted = _closer(apart, _met(wanted, below, [*by, "k"]), by, accuracy, most)
    inside = apart.filter(F.col("_v").between(F.col("low"), F.col("high"))).groupBy(*by, "k", F.col("_v").alias("value")).agg(F.count("*").alias("n"))
    counts = inside.groupBy(*by, "k").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("_counts"))
    each = _met(_met(wanted, below, [*by, "k"]), counts, [*by, "k"])
    rank = F.col("rank") - F.col("below")
    low = F.floor(rank)
    high = F.least(low + 1, F.aggregate("_counts", F.lit(0).cast("long"), lambda s, c: s + c["n"]) - 1)
    a, b = _at(F.col("_counts"), low), _at(F.col("_counts"), high)
    each = each.select(*by, "n", "k", F.when((a == b) | (rank == low), a).otherwise(a + (b - a) * (rank - low)).alias("cut"))
    return each.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cut"))), lambda c: c["cut"]).alias("cuts"))


def _closer(apart: DataFrame, wanted: DataFrame, by: list[str], accuracy: int, most: int) -> DataFrame:
    """Bounds drawn closer by a sketch of what lies between them, at fixed shares: the two around the wanted rank."""
    steps = max(4, min(64, most // 12, accuracy // 4))  # a step is more than the two ranks that are wanted and the sketch's error
    marks = [k / steps for k in range(steps + 1)]
    between = apart.filter(F.col("_v").between(F.col("low"), F.col("high")))
    sketch = between.groupBy(*by, "k").agg(F.count("*").alias("_inside"), F.percentile_approx("_v", marks, accuracy).alias("_marks"))
    rows = _met(wanted, sketch, [*by, "k"])
    at = (F.col("rank") - F.col("below")) / F.greatest(F.col("_inside"), F.lit(1)) * steps
    low = F.get("_marks", F.greatest(F.floor(at).cast("int") - 1, F.lit(0)))
    high = F.get("_marks", F.least(F.ceil(at).cast("int") + 1, F.lit(steps)))
    few = F.col("inside") <= most
    first, last = few | (F.floor(at) <= 1), few | (F.ceil(at) >= steps - 1)
    return rows.select(*by, "n", "k", "rank", F.when(first, F.col("low")).otherwise(low).alias("low"), F.when(last, F.col("high")).otherwise(high).alias("high"))
