"""Half-open boxes [start, stop) as STRUCT<start: ARRAY<BIGINT>, stop: ARRAY<BIGINT>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(start: Column, stop: Column) -> Column:
    return F.struct(start.alias("start"), stop.alias("stop"))


def size(b: Column) -> Column:
    return F.zip_with(b["stop"], b["start"], lambda e, s: e - s)


def center(b: Column) -> Column:
    return F.zip_with(b["start"], b["stop"], lambda s, e: (s + e) / 2)


def is_empty(b: Column) -> Column:
    """All sides are 0."""
    return F.forall(size(b), lambda x: x == 0)


def is_degenerate(b: Column) -> Column:
    """Some side is 0."""
    return F.exists(size(b), lambda x: x == 0)


def intersection(a: Column, b: Column) -> Column:
    """What both hold; disjoint boxes give an empty box at their common start."""
    start = F.zip_with(a["start"], b["start"], lambda x, y: F.greatest(x, y))
    stop = F.zip_with(a["stop"], b["stop"], lambda x, y: F.least(x, y))
    apart = F.exists(F.zip_with(stop, start, lambda e, s: e <= s), lambda x: x)
    return F.when(apart, box(start, start)).otherwise(box(start, stop))


def product(a: Column, b: Column) -> Column:
    """The box whose sides are a's, then b's."""
    return box(F.concat(a["start"], b["start"]), F.concat(a["stop"], b["stop"]))


def holds(b: Column, point: Column, left_closed: bool = True, right_closed: bool = False) -> Column:
    low = (lambda p, s: p >= s) if left_closed else (lambda p, s: p > s)
    high = (lambda p, e: p <= e) if right_closed else (lambda p, e: p < e)
    return F.forall(F.zip_with(point, b["start"], low), lambda x: x) & F.forall(F.zip_with(point, b["stop"], high), lambda x: x)


def covering_integers(b: Column) -> Column:
    """The integer box within a real one: ceil of start, floor of stop."""
    return box(F.transform(b["start"], F.ceil), F.transform(b["stop"], F.floor))
