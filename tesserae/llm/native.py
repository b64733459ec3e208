"""Column expressions that several operators share; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, both) -> Column:
    """``both`` (sum, maximum) of all elements before each element of an array of longs not below zero, and of all last.

    Done in runs of about the square root of the length, so that the arrays
    that grow by appending stay short.
    """
    start = F.array(F.lit(0).cast("bigint"))
    append = lambda a, x: F.array_append(a, both(F.element_at(a, -1), x))

    def whole(v: Column) -> Column:
        run = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        cuts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), run)).otherwise(F.array().cast("array<int>"))
        pieces = F.transform(cuts, lambda at: F.aggregate(F.slice(v, at, run), start, append))
        return let(pieces, joined)

    def joined(p: Column) -> Column:
        heads = F.aggregate(F.transform(p, lambda x: F.element_at(x, -1)), start, append)
        return let(
            heads,
            lambda h: F.concat(
                F.flatten(F.transform(p, lambda x, i: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: both(y, F.get(h, i))))),
                F.array(F.element_at(h, -1)),
            ),
        )

    return let(values, whole)


def running_sums(values: Column) -> Column:
    return running(values, lambda a, x: a + x)
