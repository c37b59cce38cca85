"""Array helpers built from higher-order functions (no shuffle, no Python).

Longer lambdas are written as SQL text: built from Columns, each operator is a
call to the JVM, and planning would take longer than the query on small data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    A Column is an expression, not a value: used twice it runs twice, and inside
    a lambda it runs once per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unnest(df: DataFrame, keys: Sequence[str | Column], values: Column | str, name: str) -> DataFrame:
    """One row per element of ``values``: column ``name``, never null.

    For a plain ``explode`` Catalyst infers the filter ``size(values) > 0`` and
    pushes it down, which computes an expensive array a second time.  It does
    not for the outer form, whose one row without elements is dropped after.
    """
    rows = df.select(*keys, F.explode_outer(values).alias(name))
    return rows.filter(F.col(name).isNotNull())


def unnest_structs(
    df: DataFrame, keys: Sequence[str | Column], values: Column | str, present: str
) -> DataFrame:
    """The same for an array of structs, whose field ``present`` is never null."""
    return df.select(*keys, F.inline_outer(values)).filter(F.col(present).isNotNull())


def running_sum_sql(numbers: str) -> str:
    """Inclusive prefix sums of an array of int, in O(n log n) inside one row.

    Spark has no scan over arrays, and an ``aggregate`` that appends would copy
    the array at each step.  Instead each round adds the array shifted by
    1, 2, 4, ... places to itself; log2(n) rounds are enough, the rest of the
    30 rounds only compare two numbers.
    """
    return f"""
      aggregate(sequence(0, 29), {numbers}, (total, j) ->
        if(shiftleft(1, j) >= size(total), total,
           slice(zip_with(total, concat(array_repeat(0, shiftleft(1, j)), total), (a, b) -> a + b),
                 1, size(total))))"""


def running_sum(numbers: str) -> Column:
    """:func:`running_sum_sql` of a column of int arrays, by name."""
    return F.expr(running_sum_sql(numbers))
