"""Image, annotation and slot numbers without a window over all rows.

Groups, such as images, are numbered in a table of their own: it is sorted by ranges and written, and a
range's first number is the sum over the ranges before it. Rows get their group's numbers by a join and
their place in it by a window over the group; groups too large for a task are sorted by ranges
themselves. Only the ranges' sizes, one row per shuffle partition, are summed in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.shared import fresh, written

_RANGE_BITS = 33  # of monotonically_increasing_id: the row in its partition
BIG = 1 << 20  # rows of a group beyond which it is sorted by several tasks


def positions(df: DataFrame, keys: list[str], name: str = "position", sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``name``: how many rows stand before a row in the order of ``keys`` (nulls first).

    Rows with equal keys come in an order of no meaning; give keys that tell rows apart, or rows
    that are the same anyway. ``sums`` names further columns: of a count column the sum over the rows
    before. An empty table gives an empty one. Ties and repeated rows get different positions.
    """
    sums = sums or {}
    at, part, offset, size = fresh(df.columns, "at", "part", "offset", "size")
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = written(ordered.withColumn(at, F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn(part, F.shiftright(at, _RANGE_BITS))
    sizes = ordered.groupBy(part).agg(F.count("*").alias(size), *(F.sum(c).alias(n) for c, n in sums.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sizes.select(part, so_far(size).alias(offset), *(so_far(n).alias(n) for n in sums.values()))
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    numbered = ordered.join(F.broadcast(offsets), part)
    here = F.col(at).bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))
    own = {n: F.coalesce(F.sum(c).over(within), F.lit(0)) for c, n in sums.items()}
    return numbered.select(
        *df.columns, (F.col(offset) + here).cast("bigint").alias(name), *((F.col(n) + x).cast("bigint").alias(n) for n, x in own.items())
    )


def group_numbers(df: DataFrame, group: str, name: str = "image_id", start: str = "start") -> DataFrame:
    """``(group, n, name, start)``: each distinct value, its number of rows, its 0-based rank, and the rows before it."""
    values = written(df.groupBy(group).agg(F.count("*").alias("n")), "groups")
    return positions(values, [group], name, {"n": start})


def value_ids(df: DataFrame, column: str, name: str = "image_id", gaps: bool = False) -> DataFrame:
    """``(column, n, name)``: each distinct value, its number of rows and its 0-based rank.

    Without ``gaps`` ranks are dense (images of several files); with ``gaps`` a value's rank is the number of
    rows with a smaller one (image entries of one VIA file).
    """
    place, start = fresh([column, "n"], "place", "start")
    ids = group_numbers(df, column, place, start)
    return ids.select(column, "n", F.col(start if gaps else place).alias(name))


def with_image_ids(df: DataFrame, column: str = "image_filename") -> DataFrame:
    """``df`` with a dense ``image_id``, in the order of filenames; rows without a filename go."""
    return df.drop("image_id").join(value_ids(df, column).drop("n"), column)


def slots(df: DataFrame, group: str, order: list[str], name: str = "id", groups: DataFrame | None = None) -> DataFrame:
    """``df`` with each row's 0-based place within its group, by the order of ``order``.

    ``groups``, if known, has each group's number of rows as ``n``. Groups of more than BIG rows are taken
    out and numbered by a range sort over ``(group, *order)``, so they spread over tasks.
    """
    if groups is None:
        groups = df.groupBy(group).agg(F.count("*").alias("n"))
    big, place, first = fresh(df.columns, "big", "place", "first")
    large = groups.where(F.col("n") > BIG).select(F.col(group).alias(big))
    by_group = Window.partitionBy(group).orderBy(*order)
    number = lambda rows: rows.withColumn(name, (F.row_number().over(by_group) - 1).cast("bigint"))
    if not large.head(1):
        return number(df)
    same = F.col(group).eqNullSafe(F.col(big))
    placed = positions(df.join(large, same, "left_semi"), [group, *order], place)
    least = placed.groupBy(F.col(group).alias(big)).agg(F.min(place).alias(first))
    hot = placed.join(least, same).select(*df.columns, (F.col(place) - F.col(first)).alias(name))
    return number(df.join(large, same, "left_anti")).unionByName(hot)


def numbered(
    df: DataFrame, group: str, order: list[str], place: str | None = None, slot: str | None = None, position: str | None = None
) -> DataFrame:
    """``df`` with up to three numbers: its group's rank, its place in the group, and its place among all rows.

    The last is by (group, *order): the rows of the groups before, and the place in the group. One join
    and one window, both over the rows dealt by group. Rows without a group go.
    """
    rank, start, inside = fresh([*df.columns, "n"], "rank", "start", "inside")
    groups = group_numbers(df, group, rank, start)
    rows = slots(df.join(groups.drop("n"), group), group, order, inside, groups)
    more = {place: F.col(rank), slot: F.col(inside), position: F.col(start) + F.col(inside)}
    return rows.select(*df.columns, *(x.alias(n) for n, x in more.items() if n))
