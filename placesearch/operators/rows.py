"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_once(df: DataFrame, keep: list[str], array: Column, value: str,
                 pos: str = "pos") -> DataFrame:
    """One row per element of a costly ``array`` expression, which is evaluated only once.

    For a plain explode the optimizer adds filters that compute the array again, twice; it adds
    none for the outer form, whose empty rows are dropped here.
    """
    return (df.select(*keep, F.posexplode_outer(array).alias(pos, value))
            .filter(F.col(pos).isNotNull()))
