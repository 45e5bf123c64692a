"""Union of files and removal of repeated annotations. The first row of equal ones stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.shared import fresh


def keep_first(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """One row for each distinct ``same``: the one first in ``order``. Nulls count as equal.

    A minimum per key, so it is combined before the shuffle, however often one row repeats.
    """
    rest = [c for c in df.columns if c not in same and c not in order]
    (first,) = fresh(df.columns, "first")
    least = F.min(F.struct(*order, *rest)).alias(first)
    return df.groupBy(*same).agg(least).select(*(F.col(c) if c in same else F.col(first)[c].alias(c) for c in df.columns))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables, with their place in the list as ``file_pos``."""
    return reduce(DataFrame.unionByName, [t.withColumn("file_pos", F.lit(i)) for i, t in enumerate(tables)])


def last_value(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """A map as a table: ``(key, value)``, where the last value of a key wins."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
