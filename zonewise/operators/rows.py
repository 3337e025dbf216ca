"""Row helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, items: Column | str, ix: str, item: str, *keep: Column | str) -> DataFrame:
    """keep, ix and item: one row per element of a computed array.

    The plain explode makes the optimizer test the array's size below it, which
    computes a costly array twice; the outer one with a filter on its output doesn't.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(ix, item)).where(F.col(item).isNotNull())
