"""The exportable table, the sections of a COCO document, and the document as ordered lines of text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat import schema
from quadrat.functions import boxes as B
from quadrat.operators.numbering import numbered
from quadrat.shared import fresh, lookup, written

def with_lookup(df: DataFrame, names: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """``df`` with ``value`` looked up by ``key``; ``default`` (or null) where ``names`` hasn't the key.

    ``names`` is written once. If it has few rows, each may have a large part of ``df``, so it goes to all tasks and
    ``df`` isn't shuffled: adaptive execution doesn't broadcast what a shuffle left in few partitions.
    """
    out = df.drop(value).join(lookup(names.select(key, value)), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def export_rows(boxes: DataFrame, *more: Column) -> DataFrame:
    """Canonical rows with the columns of the exportable table but for its number, and ``more``.

    Columns that may be absent are filled: category and supercategory with "", sizes with 0, and
    category ids with -1.
    """
    have = set(boxes.columns)
    filled = boxes.withColumns({c: F.lit(v).cast(schema.COLUMNS[c][0]) for c, v in schema.SENTINELS.items() if c not in have})
    side = tuple(F.col(c).cast("double") for c in ("x_min", "y_min", "width", "height"))
    return filled.select(
        "image_id", "image_filename", "image_width", "image_height",
        B.bbox(*side).alias("bbox"), B.area(side[2], side[3]).alias("area"), B.outline(*side).alias("segmentation"),
        F.coalesce("category", F.lit("")).alias("category"), "category_id",
        F.coalesce(F.col("supercategory").cast("string"), F.lit("")).alias("supercategory"), F.lit(0).alias("iscrowd"), *more,
    )


def export_table(boxes: DataFrame) -> DataFrame:
    """The exportable table: ``export_rows``, numbered anew from 0 by image and place in it."""
    (order,) = fresh(list(schema.EXPORT_COLUMNS), "order")
    rows = boxes.withColumn(order, F.col("id" if "id" in boxes.columns else "annotation_id"))
    rows = written(rows.select(*(c for c in rows.columns if c in (*schema.COLUMNS, order))), "boxes")  # read for groups and for rows
    rows = export_rows(rows, F.col(order))
    return numbered(rows, "image_id", [order], position="annotation_id").select(*schema.EXPORT_COLUMNS)


def section(table: DataFrame, name: str) -> DataFrame:
    """A section's rows under their field names; images and categories are distinct and need no numbered rows."""
    rows = table.select(*(F.col(c).alias(f) for c, f in sorted(schema.COCO_FIELDS[name].items(), key=lambda p: p[1])))
    return rows if name == "annotations" else rows.distinct()


def document_lines(table: DataFrame, info: dict) -> DataFrame:
    """``(part, id, line)``: in the order of ``part, id`` the lines are one COCO document, keys sorted, indented by two.

    The table is written once and read for each section.
    """
    table = written(table, "export")

    def text(part: int, *lines: str) -> DataFrame:
        return table.sparkSession.createDataFrame([(part, i, x) for i, x in enumerate(lines)], "part int, id bigint, line string")

    out, names = text(0, "{"), sorted(schema.COCO_FIELDS)
    for k, name in enumerate(names):
        rows = section(table, name)
        own = F.col("id") if name == "annotations" else F.struct(*rows.columns)  # tells rows apart
        first = F.broadcast(rows.agg(F.min(own).alias("__first")))  # one row
        fields = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        rows = rows.withColumn("line", F.concat(F.lit("    "), fields)).join(first, F.lit(True))
        comma = F.when(own == F.col("__first"), " ").otherwise(",")
        rows = rows.select(F.lit(3 * k + 2).alias("part"), F.col("id").cast("bigint"), F.concat(comma, "line").alias("line"))
        out = out.unionByName(text(3 * k + 1, f'  "{name}": [')).unionByName(rows).unionByName(text(3 * k + 3, "  ],"))
    body = json.dumps({"info": info}, indent=2, sort_keys=True).split("\n")[1:]
    return out.unionByName(text(3 * len(names) + 1, *body))
