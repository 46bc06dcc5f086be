"""Values that expressions on arrays need: bound once, summed up along an array, searched in order.

A value used several times in an expression is evaluated once by ``let``.

Spark shares equal subexpressions between the columns of a projection, but not inside the lambdas of
higher-order functions. A one-element array that is transformed binds its element to the lambda's
variable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _powers(most: Column, down: bool = False) -> Column:
    """1, 2, 4, ... up to ``most``, or from there down."""
    powers = [1 << k for k in range(31)]
    return F.filter(F.array(*[F.lit(p) for p in (reversed(powers) if down else powers)]), lambda p: p <= most)


def running_sums(values: Column) -> Column:
    """The sums of an array's elements up to each one: each round adds what stands 1, 2, 4, ... places before."""
    added = lambda sums, back: F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(0))
    return F.aggregate(_powers(F.size(values) - 1), values, added)


def first_not_below(array: Column, key: Callable[[Column], Column], least: Column) -> Column:
    """How many elements of an array sorted by ``key`` have a key below ``least``: a binary search."""
    below = lambda at: key(F.get(array, at)) < least
    return F.aggregate(_powers(F.size(array), down=True), F.lit(0), lambda n, p: F.when((n + p <= F.size(array)) & below(n + p - 1), n + p).otherwise(n))
