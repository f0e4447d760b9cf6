"""The n-th smallest row without sorting the table: counts per range, refined until the range is small."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

RANGES = 4096            # counted in one scan
SMALL = 20_000           # rows that may be sorted in one task


@dataclass
class Place:
    """The wanted row is the ``left``-th of the rows whose key lies from ``low`` to ``high``."""
    low: int
    high: int
    left: int


def narrowed(rows: DataFrame, key: str, n: int, ranges: int = RANGES, small: int = SMALL) -> Place | None:
    """Where the ``n``-th smallest ``key`` (whole numbers) lies; None if there are fewer rows.

    Each round is one scan that counts rows per range of keys; the range that holds the wanted row is
    cut again, until it has few rows or one key.  ``rows`` should be narrow.
    """
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n")).first()
    if n < 1 or ends.n < n:
        return None
    place, count = Place(ends.low, ends.high, n), ends.n
    while count > small and place.high > place.low:
        width = -(-(place.high - place.low + 1) // ranges)
        inside = rows.filter(F.col(key).between(place.low, place.high))
        # the difference of two longs may need more than a long
        at = F.floor((F.col(key).cast("decimal(20,0)") - F.lit(place.low).cast("decimal(20,0)")) / F.lit(width)
                     .cast("decimal(20,0)")).cast("int")
        for found in sorted(inside.groupBy(at.alias("at")).count().collect()):
            if place.left <= found["count"]:
                low = place.low + found["at"] * width
                place, count = Place(low, min(place.high, low + width - 1), place.left), found["count"]
                break
            place.left -= found["count"]
    return place


def first_rows(rows: DataFrame, key: str, order: str, n: int, small: int = SMALL) -> Column:
    """Whether a row is among the first ``n`` by ``order``, of which ``key`` is a coarser whole number.

    Orders are unique.  Only the rows of the last range, few unless many keys are equal, are sorted.
    """
    place = narrowed(rows.select(key), key, n, small=small)
    if place is None:
        return F.lit(n >= 1)
    inside = rows.filter(F.col(key).between(place.low, place.high)).select(order)
    last = inside.orderBy(order).limit(place.left).agg(F.max(order).alias("m")).first().m
    return (F.col(key) < place.low) | ((F.col(key) <= place.high) & (F.col(order) <= last))
