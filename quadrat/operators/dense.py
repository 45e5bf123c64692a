"""Between the long table (a row per box) and the padded view (a row per image, arrays of one length).

The long table is the form to store and query: in the padded view one crowded image lengthens the arrays of
all. An image's boxes are one row there by definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat import schema
from quadrat.functions import boxes as B
from quadrat.operators.numbering import slots
from quadrat.shared import fresh, written

NAN = float("nan")


def with_slots(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``id``: the 0-based place of a box within its image, by ``annotation_id``."""
    return slots(boxes, "image_id", ["annotation_id"], "id")


def without_empty_columns(boxes: DataFrame) -> DataFrame:
    """Columns that hold nothing but their sentinel go; one aggregate decides. An empty table keeps all."""
    have = [c for c in schema.SENTINELS if c in boxes.columns]
    if not have:
        return boxes
    row = boxes.agg(*(F.bool_and(F.col(c) == F.lit(schema.SENTINELS[c])).alias(c) for c in have)).first()
    return boxes.drop(*(c for c in have if row[c]))


def boxes_per_image(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("image_id").agg(F.count("*").alias("n_boxes"))


def conflicting_sizes(boxes: DataFrame) -> DataFrame:
    """``image_filename`` of the images that have several sizes."""
    size = F.struct("image_width", "image_height")
    sizes = boxes.groupBy("image_filename").agg(F.min(size).alias("a"), F.max(size).alias("b"))
    return sizes.where("a <> b").select("image_filename")


def check_image_sizes(boxes: DataFrame) -> None:
    """An image must have one size; names up to ten images that have several."""
    bad = [r[0] for r in conflicting_sizes(boxes).orderBy("image_filename").limit(10).collect()]
    if bad:
        raise ValueError(f"Images with more than one size: {bad}")


def _padded(value, pad, length):
    return F.concat(value, F.array_repeat(pad, F.greatest(length - F.size(value), F.lit(0))))


def padded(rows: DataFrame, group: str, slot: str, values: dict[str, object]) -> DataFrame:
    """A row per group: ``values`` as arrays in the order of ``slot``, filled up with their pad to one length."""
    taken, most = fresh([group, *values], "taken", "most")
    wide = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(slot, *values))).alias(taken))
    longest = F.broadcast(rows.groupBy(group).agg(F.count("*").alias(most)).agg(F.max(most).cast("int").alias(most)))  # one row
    kinds = dict(rows.dtypes)
    return wide.join(longest, F.lit(True)).select(
        group, *(_padded(F.col(f"{taken}.{c}"), F.lit(pad).cast(kinds[c]), F.col(most)).alias(c) for c, pad in values.items())
    )


def dense_view(boxes: DataFrame) -> DataFrame:
    """A row per image with ``position_x, position_y, shape_x, shape_y`` (box centres and sizes; NaN pads),
    ``category`` (ids; -1 pads) and ``image_shape``, the last two if their columns are not empty.

    The boxes are written once, as their columns, sizes and longest image are each asked for.
    """
    full = without_empty_columns(written(boxes, "boxes"))
    rows = (full if "id" in full.columns else with_slots(full)).withColumns({
        "position_x": B.center(F.col("x_min"), F.col("width")), "position_y": B.center(F.col("y_min"), F.col("height")),
        "shape_x": F.col("width"), "shape_y": F.col("height"),
    })
    values = {c: NAN for c in ("position_x", "position_y", "shape_x", "shape_y")}
    has_category = {"category_id", "category"} <= set(full.columns)
    if has_category:
        rows, values = rows.drop("category").withColumnRenamed("category_id", "category"), values | {"category": -1}
    out = padded(rows, "image_id", "id", values)
    if {"image_width", "image_height"} <= set(full.columns):
        check_image_sizes(full)
        sizes = full.groupBy("image_id").agg(F.array(F.min("image_width"), F.min("image_height")).alias("image_shape"))
        out = out.join(sizes, "image_id")
    return out


def long_view(dense: DataFrame) -> DataFrame:
    """A row per image and slot of the padded view; slots with a null or NaN in position or shape go."""
    names = [c for c in ("position_x", "position_y", "shape_x", "shape_y", "category") if c in dense.columns]
    rows = dense.select(
        "image_id", *(c for c in dense.columns if c not in names and c != "image_id"), F.posexplode(F.arrays_zip(*names)).alias("id", "v")
    )
    rows = rows.select(*(c for c in rows.columns if c != "v"), *(F.col(f"v.{c}").alias(c) for c in names))
    rows = rows.dropna("any", subset=names[:4])
    out = rows.withColumns({
        "x_min": B.corner(F.col("position_x"), F.col("shape_x")), "y_min": B.corner(F.col("position_y"), F.col("shape_y")),
        "width": F.col("shape_x"), "height": F.col("shape_y"),
    })
    return out.withColumnRenamed("category", "category_id") if "category" in out.columns else out


def by_space(rows: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """A row per ``keys`` and axis: ``space`` is x or y, each pair of columns becomes one."""
    axes = [F.struct(F.lit(s).alias("space"), *(F.col(p[i]).alias(v) for v, p in pairs.items())) for i, s in enumerate("xy")]
    return rows.select(*keys, F.inline(F.array(*axes)))


def from_space(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The reverse of ``by_space``: columns ``<value>_x`` and ``<value>_y``. Fixed axes, so no pass to find them."""
    picks = [F.max(F.when(F.col("space") == s, F.col(v))).alias(f"{v}_{s}") for v in values for s in "xy"]
    return rows.groupBy(*keys).agg(*picks)


def track_table(boxes: DataFrame) -> DataFrame:
    """Boxes as tracks: images become times, slots become individuals ``id_<slot>``, and no confidence is known yet."""
    rows = boxes if "id" in boxes.columns else with_slots(boxes)
    return rows.select(
        F.col("image_id").alias("time"), F.concat(F.lit("id_"), F.col("id").cast("string")).alias("individuals"),
        B.center(F.col("x_min"), F.col("width")).alias("position_x"), B.center(F.col("y_min"), F.col("height")).alias("position_y"),
        F.col("width").alias("shape_x"), F.col("height").alias("shape_y"), F.lit(NAN).alias("confidence"),
    )
