"""Column expressions on boxes, image sizes, categories and filenames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def center(low: Column, extent: Column) -> Column:
    return low + extent / 2


def corner(middle: Column, extent: Column) -> Column:
    return middle - extent / 2


def bbox(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(x, y, w, h)


def area(w: Column, h: Column) -> Column:
    return w * h


def outline(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The box as a polygon: clockwise from the top left corner, in one flat list."""
    return F.array(F.array(x, y, x + w, y, x + w, y + h, x, y + h))


def size_as_integer(value: Column) -> Column:
    """An image width or height, a VARIANT: numbers lose their fraction, texts must be whole numbers; 0 for all else."""
    return F.coalesce(F.try_variant_get(value, "$", "bigint"), F.lit(0).cast("bigint"))


def category_number(value: Column, options: Column) -> Column:
    """A category key as integer; a key that isn't one counts by its place in the sorted keys, from 1.

    Null where the key is neither.
    """
    place = F.array_position(F.array_sort(options), value)
    return F.coalesce(F.trim(value).try_cast("bigint"), F.when(place > 0, place))


def first_key(mapping: Column) -> Column:
    return F.array_min(F.map_keys(mapping))


def path_part(filename: Column, delimiters: list[str], place: int) -> Column:
    """A part of a path, split at the first of ``delimiters`` that occurs in it; null if there is no such part.

    Places count from 1; negative ones from the end.
    """
    part = F.lit(None).cast("string")
    for d in reversed(delimiters):
        pieces = F.split(filename, "\\Q" + d + "\\E")
        part = F.when(F.contains(filename, F.lit(d)), F.try_element_at(pieces, F.lit(place))).otherwise(part)
    return part


def in_rectangle(x: Column, y: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Edges count as inside; null or NaN points are outside."""
    inside = x.between(low[0], high[0]) & y.between(low[1], high[1])
    return F.coalesce(inside, F.lit(False))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule, by the edges above a point; points on an edge count as inside, null or NaN points as outside."""
    above, on_edge = [], []
    for a, b in zip(corners, corners[1:] + corners[:1]):
        (ax, ay), (bx, by) = sorted((a, b))
        if ax == bx:
            on_edge.append((x == ax) & y.between(ay, by))
            continue
        height = F.lit(ay) + (x - ax) * F.lit((by - ay) / (bx - ax))  # of the edge at x, from its left end
        on_edge += [x.between(ax, bx) & (y == height), (x == bx) & (y == by)]
        above.append(((x >= ax) & (x < bx) & (height > y)).cast("int"))
    odd = reduce(Column.__add__, above) % 2 == 1 if above else F.lit(False)
    inside = reduce(Column.__or__, on_edge, odd)
    return F.coalesce(inside & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of ``value`` among equal ones from ``low`` to ``high``; the last bin holds its upper edge."""
    place = F.floor((value - low) / ((high - low) / F.lit(bins)))
    return F.when(high > low, F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)).cast("bigint")
