"""Folds over long arrays in chunks, so that what is done is copied once a chunk instead of once an element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a chunk.
CHUNK = 256


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once: an array of one element binds it to the lambda's argument."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def chunks(values: Column) -> Column:
    """An array's slices of CHUNK elements, one empty slice for an empty array."""
    last = F.greatest(F.floor((F.size(values) - 1) / CHUNK), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))


def running_sums(values: Column) -> Column:
    """The sum of all elements before each one (long), in order; as many as there are."""
    zero = F.expr("array(0L)")
    sums = lambda xs: F.aggregate(xs, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))  # noqa: E731  one more than xs

    def offset(inner: Column) -> Column:
        starts = sums(F.transform(inner, lambda p: F.element_at(p, -1)))
        placed = F.zip_with(F.slice(starts, F.lit(1), F.size(inner)), inner, lambda o, p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + o))
        return F.flatten(placed)

    return bound(F.transform(bound(values, chunks), sums), offset)
