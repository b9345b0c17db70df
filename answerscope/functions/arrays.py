"""Folds over arrays inside a row, in time that grows with the array and not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An array that is appended to k times is copied k times, so folds that build one go block by block.
BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """An array of combine over the elements up to and with each one; combine is associative."""
    last = lambda a: F.element_at(a, -1)

    def folded(items: Column, first: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.slice(items, 2, F.size(items)), first, lambda acc, x: F.array_append(acc, combine(last(acc), value(x))))

    def joined(blocks: Column) -> Column:
        totals = folded(blocks, F.slice(F.transform(blocks, last), 1, 1), last)
        return bound(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: combine(F.get(t, i - 1), x))))))

    def whole(a: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(places, lambda k: bound(F.slice(a, k, F.lit(BLOCK)), lambda b: folded(b, F.slice(b, 1, 1), lambda x: x)))
        return F.when(F.size(a) > 0, bound(blocks, joined)).otherwise(a)

    return bound(values, whole)


def grouped(items: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """items as an array of arrays: a new one begins with the first item, and where starts(item, place) says so."""

    def cut(a: Column) -> Column:
        firsts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | starts(x, i), i)), lambda i: i.isNotNull())
        return bound(firsts, lambda f: F.transform(f, lambda s, j: F.slice(a, s + 1, F.coalesce(F.get(f, j + 1), F.size(a)) - s)))

    return bound(items, cut)
