"""Annotation documents as canonical rows.

Documents come taken apart into elements, so one large file is read, checked and parsed by many tasks. Images
and entries are numbered by range sorts over (file, name), whatever the size of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat import schema
from quadrat.functions import boxes as B
from quadrat.operators.dedup import keep_first
from quadrat.operators.numbering import numbered, positions, slots
from quadrat.shared import lookup, written
from quadrat.sources.elements import Documents, of_texts, read_documents

__all__ = ["FORMATS", "Documents", "check_format", "coco_rows", "document_rows", "of_texts", "read_documents", "several_files", "single_file", "via_rows"]

FORMATS = ("VIA", "COCO")


def check_format(format: str) -> None:
    if format not in FORMATS:
        raise ValueError(f"Unsupported format: {format}")


def _or_error(value, message: str, *of):
    return F.coalesce(value, F.raise_error(F.format_string(message, *of)).cast("string"))


def _section(docs: Documents, name: str, kind: str) -> DataFrame:
    """``file_pos, place, key, e``: the parsed elements of a section that is an array (``[``) or an object."""
    rows = docs.elements.where((F.col("section") == name) & (F.col("kind") == kind))
    return rows.select("file_pos", "place", "key", F.from_json("value", schema.ELEMENTS[name]).alias("e"))


def coco_rows(docs: Documents) -> DataFrame:
    """Canonical rows with ``file_pos`` of COCO documents.

    Images are numbered by the order of filenames in their file, then by their place in the file, whether they
    have annotations or not. Of categories with one id the last counts. An annotation whose image or
    category isn't in its file is an error, as is a box that hasn't four numbers.
    """
    image = _section(docs, "images", "[").select(
        "file_pos", "place", F.col("e.id").alias("source_image"), F.col("e.file_name").alias("image_filename"),
        *(B.size_as_integer(F.col(f"e.{c}")).alias(f"image_{c}") for c in ("width", "height")),
    )
    image = slots(image, "file_pos", ["image_filename", "place"], "image_id").drop("place")
    category = (
        _section(docs, "categories", "[")
        .groupBy("file_pos", F.col("e.id").alias("category_id"))
        .agg(F.max_by("e", "place").alias("c"))
        .select("file_pos", "category_id", F.col("c.name").alias("category"), F.coalesce("c.supercategory", F.lit("")).alias("supercategory"))
    )
    box = _section(docs, "annotations", "[").select(
        "file_pos", F.col("place").alias("annotation_id"), F.col("e.image_id").alias("source_image"), "e.category_id",
        F.when(F.size("e.bbox") == 4, F.col("e.bbox")).otherwise(F.raise_error(F.lit("A box needs four numbers."))).alias("b"),
    )
    joined = box.join(image, ["file_pos", "source_image"], "left").join(lookup(category, "categories"), ["file_pos", "category_id"], "left")
    return joined.select(
        "file_pos", "annotation_id",
        _or_error(F.col("image_filename"), "No image with id %s.", F.col("source_image")).alias("image_filename"),
        "image_id", "image_width", "image_height",
        *(F.col("b")[i].alias(c) for i, c in enumerate(("x_min", "y_min", "width", "height"))),
        "supercategory", _or_error(F.col("category"), "No category with id %s.", F.col("category_id")).alias("category"), "category_id",
    )


def via_rows(docs: Documents) -> DataFrame:
    """Canonical rows with ``file_pos`` of VIA documents.

    Images are numbered by the rank of their filename among all entries of their file; equal filenames share
    the first rank. A region's supercategory is its first attribute in alphabetical order; a region or file
    without attributes has no category. Of entries under one key the last counts, at the place of the first.
    """
    entry = written(_section(docs, "_via_img_metadata", "{"), "entries")
    narrow = written(entry.select("file_pos", "place", F.col("e.filename").alias("name"), F.greatest(F.size("e.regions"), F.lit(0)).cast("bigint").alias("n")), "names")
    names = positions(narrow.groupBy("file_pos", "name").agg(F.count("*").alias("entries")), ["file_pos", "name"], "at", {"entries": "entries_before"})
    places = positions(narrow, ["file_pos", "place"], "at", {"n": "boxes_before"})
    of_file = lambda df, c, name: df.groupBy("file_pos").agg(F.min(c).alias(name))
    starts = of_file(names, "entries_before", "first_entry").join(of_file(places, "boxes_before", "first_box"), "file_pos")
    numbers = places.join(names.select(F.col("file_pos").alias("f"), F.col("name").alias("of"), "entries_before"), (F.col("f") == F.col("file_pos")) & F.col("of").eqNullSafe(F.col("name")))
    numbers = numbers.join(starts, "file_pos").select(
        "file_pos", "place", (F.col("entries_before") - F.col("first_entry")).alias("image_id"), (F.col("boxes_before") - F.col("first_box")).alias("boxes_before"))
    box = entry.select("file_pos", "place", "e").join(numbers, ["file_pos", "place"]).select(
        "file_pos", "image_id", "boxes_before", F.col("e.filename").alias("image_filename"),
        B.size_as_integer(F.try_element_at("e.file_attributes", F.lit("width"))).alias("image_width"),
        B.size_as_integer(F.try_element_at("e.file_attributes", F.lit("height"))).alias("image_height"),
        F.posexplode("e.regions").alias("place", "r"),
    )
    box = box.withColumn("sc", B.first_key(F.col("r.region_attributes")))
    box = box.withColumn("cid", F.try_element_at("r.region_attributes", F.col("sc")))
    regions = docs.elements.where("section = '_via_attributes' and kind = '{' and key = 'region'")
    regions = regions.select("file_pos", F.from_json("value", schema.ELEMENTS["_via_attributes"]).alias("region"))
    named = regions.select("file_pos", F.explode("region").alias("sc", "of"))
    options = named.select("file_pos", "sc", F.map_keys("of.options").alias("keys"), F.explode("of.options").alias("cid", "name"))
    options = options.select("file_pos", "sc", "cid", "name", B.category_number(F.col("cid"), F.col("keys")).alias("number"))
    some = regions.select("file_pos", (F.size("region") > 0).alias("has_categories"))
    box = box.join(lookup(options, "options"), ["file_pos", "sc", "cid"], "left").join(lookup(some, "regions"), "file_pos", "left")
    has = F.col("sc").isNotNull() & F.coalesce("has_categories", F.lit(False))
    name = _or_error(F.col("name"), "No category %s under %s.", F.col("cid"), F.col("sc"))
    return box.select(
        "file_pos", (F.col("boxes_before") + F.col("place")).cast("bigint").alias("annotation_id"),
        "image_filename", "image_id", "image_width", "image_height",
        F.col("r.shape_attributes.x").alias("x_min"), F.col("r.shape_attributes.y").alias("y_min"),
        F.col("r.shape_attributes.width").alias("width"), F.col("r.shape_attributes.height").alias("height"),
        F.when(has, F.col("sc")).otherwise("").alias("supercategory"),
        F.when(has, name).otherwise("").alias("category"),
        F.when(has, F.col("number")).otherwise(-1).cast("bigint").alias("category_id"),
    )


def document_rows(docs: Documents | DataFrame, format: str) -> DataFrame:
    """Canonical rows of documents taken apart, or of whole texts as ``(file_pos, file, value)``."""
    check_format(format)
    docs = docs if isinstance(docs, Documents) else of_texts(docs)
    rows = via_rows(docs) if format == "VIA" else coco_rows(docs)
    return rows.select("file_pos", *schema.COLUMNS)


def single_file(rows: DataFrame) -> DataFrame:
    """The table of one file: repeated rows go, the first stays with its number, so numbers may have gaps."""
    rows = rows.drop("file_pos")
    return keep_first(rows, [c for c in schema.COLUMNS if c != "annotation_id"], ["annotation_id"]).select(*schema.COLUMNS)


def several_files(rows: DataFrame) -> DataFrame:
    """One table of all files: images numbered by filename over all files, repeated rows gone, rows numbered anew.

    Image sizes don't tell rows apart: of rows that differ only in them the first stays.
    """
    free = ("annotation_id", "image_id", "image_width", "image_height")
    rows = keep_first(rows, [c for c in schema.COLUMNS if c not in free], ["file_pos", "annotation_id"])
    rows = written(rows.withColumnRenamed("annotation_id", "source_id").drop("image_id"), "distinct")
    return numbered(rows, "image_filename", ["file_pos", "source_id"], place="image_id", position="annotation_id").select(*schema.COLUMNS)
