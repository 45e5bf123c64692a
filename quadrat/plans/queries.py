"""The library's operators over the driver's tables: each query with the SQL that gives the same rows.

``lineitem`` stands for boxes: an order is an image, a line a box. (l_orderkey, l_linenumber) isn't a key,
so rows are ordered by all columns; rows that are still equal are interchangeable.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.dataset import Dataset, from_files, maps, split_dataset_group_by, split_dataset_random, to_COCO_file
from quadrat.functions import boxes as B
from quadrat.operators import dense, export, numbering, regions, split
from quadrat.operators.dedup import keep_first, last_value, union_all
from quadrat.schema import COCO_FIELDS, SENTINELS
from quadrat.shared import scratch, written
from quadrat.sources import documents
from quadrat.sources.checks import document_errors, export_rule_counts, index_rule, key_error

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEED = 42
SIZE = (1280, 720)
LINE = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]

#: CTEs of every query's SQL: boxes as `lineitem` gives them, and as numbered rows of one table.
_LINE_SQL = ", ".join(LINE)
BOXES_SQL = f"""
boxes AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '.jpg' AS image_filename, l_orderkey, l_quantity AS x_min,
    l_extendedprice AS y_min, l_discount AS width, l_tax AS height, l_linestatus AS supercategory, l_returnflag AS category,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS category_id, {_LINE_SQL} FROM lineitem),
ided AS (SELECT *, dense_rank() OVER (ORDER BY image_filename) - 1 AS image_id FROM boxes),
slotted AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_LINE_SQL}) - 1 AS id FROM ided)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def with_boxes(select: str) -> str:
    """SQL after the shared CTEs; further CTEs begin with a comma."""
    return f"WITH {BOXES_SQL} {select}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit(".jpg")).alias("image_filename"), "l_orderkey",
        F.col("l_quantity").alias("x_min"), F.col("l_extendedprice").alias("y_min"), F.col("l_discount").alias("width"),
        F.col("l_tax").alias("height"), F.col("l_linestatus").alias("supercategory"), flag.alias("category"),
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).cast("bigint").alias("category_id"), *LINE,
    )


def slotted(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Boxes with image and slot numbers: images are numbered in their own table, boxes within their image."""
    rows = numbering.numbered(boxes(spark, sf_dir), "image_filename", LINE, place="image_id", slot="id")
    return rows.select("image_id", *dict.fromkeys([*LINE, *columns]), "id")


# --- numbering ---------------------------------------------------------------------------------------


@query(with_boxes("SELECT image_filename, CAST(image_id AS BIGINT) AS image_id, count(*) AS n FROM ided GROUP BY ALL"))
def image_id_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.value_ids(boxes(spark, sf_dir), "image_filename")


@query("""
SELECT image_filename, count(*) AS n, CAST(min(r) AS BIGINT) AS image_id FROM (
  SELECT f AS image_filename, rank() OVER (ORDER BY f) - 1 AS r
  FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 12, '0') || '.jpg' AS f FROM orders)) GROUP BY image_filename
""")
def image_id_rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one file: filenames repeat, and a filename's number is that of its first entry."""
    return numbering.value_ids(_entries(spark, sf_dir), "image_filename", gaps=True)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lpad(F.col("o_custkey").cast("string"), 12, "0"), F.lit(".jpg"))
    return table(spark, sf_dir, "orders").select(name.alias("image_filename"), "o_orderkey")


@query("""
SELECT lpad(CAST(o_custkey AS VARCHAR), 12, '0') || '.jpg' AS image_filename, o_orderkey,
  CAST(row_number() OVER (ORDER BY lpad(CAST(o_custkey AS VARCHAR), 12, '0'), o_orderkey) - 1 AS BIGINT) AS image_id FROM orders
""")
def image_id_rownum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one file: every entry has its own number."""
    return numbering.positions(_entries(spark, sf_dir), ["image_filename", "o_orderkey"], "image_id")


@query(with_boxes(f"SELECT l_orderkey, {_LINE_SQL}, CAST(image_id AS BIGINT) AS image_id, CAST(id AS BIGINT) AS id FROM slotted"))
def slot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slotted(spark, sf_dir, "l_orderkey")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS id FROM conversations")
def slot_ids_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.slots(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"])


@query("SELECT user_id, min(rn) AS first, max(rn) AS last FROM (SELECT user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events) GROUP BY user_id")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last place of each group in the order of the rows."""
    placed = numbering.positions(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["ts", "event_id"])
    return placed.groupBy("user_id").agg(F.min("position").alias("first"), F.max("position").alias("last"))


# --- dedup and union ---------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text; digests go through the shuffle in place of texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 512).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("digest")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1
""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


_FILE_COLUMNS = ["image_filename", "x_min", "y_min", "width", "height", "supercategory", "category"]


@query(f"""
WITH {BOXES_SQL},
files AS (
  SELECT 0 AS file_pos, {", ".join(_FILE_COLUMNS)} FROM boxes WHERE x_min <= 30
  UNION ALL SELECT 1 AS file_pos, {", ".join(_FILE_COLUMNS)} FROM boxes WHERE x_min >= 20),
one AS (SELECT min(file_pos) AS file_pos, {", ".join(_FILE_COLUMNS)} FROM files GROUP BY ALL)
SELECT {", ".join(_FILE_COLUMNS)}, CAST(dense_rank() OVER (ORDER BY image_filename) - 1 AS BIGINT) AS image_id,
  CAST(row_number() OVER (ORDER BY image_filename, file_pos, x_min, y_min, width, height, supercategory, category) - 1 AS BIGINT) AS annotation_id
FROM one
""")
def union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping tables made one: union, dedup, image numbers over both, rows numbered anew."""
    rows = boxes(spark, sf_dir).select(*_FILE_COLUMNS)
    both = union_all([rows.where("x_min <= 30"), rows.where("x_min >= 20")])
    one = written(keep_first(both, _FILE_COLUMNS, ["file_pos"]), "distinct")
    order = ["file_pos", *_FILE_COLUMNS[1:]]
    return numbering.numbered(one, "image_filename", order, place="image_id", position="annotation_id").drop("file_pos")


@query("SELECT c_nationkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey")
def map_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_value(table(spark, sf_dir, "customer"), "c_nationkey", "c_name", ["c_custkey"])


# --- counts and reshaping ----------------------------------------------------------------------------


@query("SELECT l_orderkey AS image_id, count(*) AS n_boxes FROM lineitem GROUP BY l_orderkey")
def annots_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.boxes_per_image(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image_id"))


@query("SELECT max(n) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def max_annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image_id")
    return dense.boxes_per_image(rows).agg(F.max("n_boxes").alias("n"))


@query("SELECT l_returnflag AS grp, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def group_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey").select(F.col("l_returnflag").alias("grp"), "n")


@query("""
WITH t AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id FROM conversations),
slot AS (SELECT unnest(range((SELECT max(id) + 1 FROM t))) AS id)
SELECT c.conv_id, CAST(slot.id AS BIGINT) AS id, CAST(coalesce(t.n, -1) AS BIGINT) AS n
FROM (SELECT DISTINCT conv_id FROM conversations) c, slot LEFT JOIN t ON t.conv_id = c.conv_id AND t.id = slot.id
""")
def pad_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged turns padded to one length, shown a row per slot."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    wide = dense.padded(rows, "conv_id", "turn", {"n": -1})
    return wide.select("conv_id", F.posexplode("n").alias("id", "n")).withColumn("id", F.col("id").cast("bigint"))


@query(with_boxes("""
SELECT CAST(image_id AS BIGINT) AS image_id, CAST(id AS BIGINT) AS id, round(x_min + width / 2 - width / 2, 6) AS x_min,
  round(y_min + height / 2 - height / 2, 6) AS y_min, width, height, category_id FROM slotted
""").replace("category_id FROM slotted", "CAST(category_id AS BIGINT) AS category_id FROM slotted"))
def dense_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long to padded arrays and back: padding goes, every box stays."""
    rows = slotted(spark, sf_dir, "category", "category_id", "x_min", "y_min", "width", "height")
    back = dense.long_view(dense.dense_view(rows))
    return back.select(
        "image_id", F.col("id").cast("bigint"), F.round("x_min", 6).alias("x_min"), F.round("y_min", 6).alias("y_min"),
        "width", "height", "category_id",
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + l_discount / 2 AS position_x, l_extendedprice + l_tax / 2 AS position_y,
  l_quantity + l_discount / 2 - l_discount / 2 AS x_min FROM lineitem
""")
def center_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = B.center(F.col("l_quantity"), F.col("l_discount"))
    y = B.center(F.col("l_extendedprice"), F.col("l_tax"))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(*keys, "l_discount", x.alias("position_x"), y.alias("position_y"))
    return rows.select(*keys, "position_x", "position_y", B.corner(F.col("position_x"), F.col("l_discount")).alias("x_min"))


@query("""
SELECT o_orderkey, 'x' AS space, o_totalprice AS position, CAST(o_custkey AS DOUBLE) AS shape FROM orders
UNION ALL SELECT o_orderkey, 'y', o_totalprice / 2, CAST(o_custkey AS DOUBLE) / 2 FROM orders
""")
def unpivot_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _axes(spark, sf_dir)


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("px"), (F.col("o_totalprice") / 2).alias("py"),
        F.col("o_custkey").cast("double").alias("sx"), (F.col("o_custkey").cast("double") / 2).alias("sy"),
    )
    return dense.by_space(rows, ["o_orderkey"], {"position": ("px", "py"), "shape": ("sx", "sy")})


@query("""
SELECT o_orderkey, o_totalprice AS position_x, o_totalprice / 2 AS position_y, CAST(o_custkey AS DOUBLE) AS shape_x,
  CAST(o_custkey AS DOUBLE) / 2 AS shape_y FROM orders
""")
def pivot_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.from_space(_axes(spark, sf_dir), ["o_orderkey"], ["position", "shape"])


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
def drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that hold nothing but their sentinel go."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return dense.without_empty_columns(rows.withColumns({c: F.lit(v) for c, v in SENTINELS.items()}))


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value").dropna("any", subset=["value"])


@query("SELECT DISTINCT l_returnflag || l_linenumber AS image_filename FROM lineitem GROUP BY l_returnflag || l_linenumber HAVING count(DISTINCT l_tax) > 1")
def image_size_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("image_filename"),
        F.col("l_tax").alias("image_width"), F.lit(1).alias("image_height"),
    )
    return dense.conflicting_sizes(rows)


@query(with_boxes(f"""
SELECT CAST(image_id AS BIGINT) AS image_id, CAST((SELECT max(id) + 1 FROM slotted) AS INTEGER) AS slots, CAST(count(*) AS INTEGER) AS boxes,
  CAST({SIZE[0]} AS BIGINT) AS image_width, CAST({SIZE[1]} AS BIGINT) AS image_height, min(x_min + width / 2) AS least_x, max(category_id) AS last_category
FROM slotted GROUP BY image_id
""").replace("max(category_id) AS last", "CAST(max(category_id) AS BIGINT) AS last"))
def dense_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padded view with all of its arrays: their common length, what isn't padding, and the image's shape."""
    rows = slotted(spark, sf_dir, "image_filename", "category", "category_id", "x_min", "y_min", "width", "height")
    wide = dense.dense_view(rows.withColumns({"image_width": F.lit(SIZE[0]).cast("bigint"), "image_height": F.lit(SIZE[1]).cast("bigint")}))
    some = F.filter("position_x", lambda x: ~F.isnan(x))
    return wide.select(
        "image_id", F.size("shape_y").alias("slots"), F.size(some).alias("boxes"), F.col("image_shape")[0].alias("image_width"),
        F.col("image_shape")[1].alias("image_height"), F.array_min(some).alias("least_x"), F.array_max("category").alias("last_category"),
    )


# --- export ------------------------------------------------------------------------------------------


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slotted(spark, sf_dir, "image_filename", "x_min", "y_min", "width", "height", "supercategory", "category", "category_id")
    return export.export_table(rows.withColumns({"image_width": F.lit(SIZE[0]).cast("bigint"), "image_height": F.lit(SIZE[1]).cast("bigint")}))


@query(with_boxes("""
SELECT CAST(row_number() OVER (ORDER BY image_id, id) - 1 AS BIGINT) AS annotation_id, CAST(image_id AS BIGINT) AS image_id,
  x_min AS x, y_min AS y, width AS w, height AS h, width * height AS area, x_min + width AS right_x, y_min + height AS low_y,
  CAST(category_id AS BIGINT) AS category_id, supercategory, 0 AS iscrowd FROM slotted
"""))
def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    box, outline = F.col("bbox"), F.col("segmentation")[0]
    return _export(spark, sf_dir).select(
        "annotation_id", "image_id", *(box[i].alias(c) for i, c in enumerate("xywh")), "area",
        outline[4].alias("right_x"), outline[5].alias("low_y"), "category_id", "supercategory", "iscrowd",
    )


def _unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sections of images and categories need: export rows without slots and numbers."""
    rows = numbering.with_image_ids(boxes(spark, sf_dir))
    return export.export_rows(rows.withColumns({"image_width": F.lit(SIZE[0]).cast("bigint"), "image_height": F.lit(SIZE[1]).cast("bigint")}))


@query(with_boxes(f"SELECT DISTINCT image_filename AS file_name, CAST(image_id AS BIGINT) AS id, CAST({SIZE[0]} AS BIGINT) AS width, CAST({SIZE[1]} AS BIGINT) AS height FROM ided"))
def coco_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.section(_unnumbered(spark, sf_dir), "images")


@query(with_boxes("SELECT DISTINCT CAST(category_id AS BIGINT) AS id, category AS name, supercategory FROM boxes"))
def coco_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.section(_unnumbered(spark, sf_dir), "categories")


@query(with_boxes(f"""
SELECT 'annotations' AS section, CAST(row_number() OVER (ORDER BY image_id, id) - 1 AS BIGINT) AS id, CAST(image_id AS BIGINT) AS image_id, x_min AS x,
  y_min AS y, width AS w, height AS h, width * height AS area, CAST(category_id AS BIGINT) AS category_id, NULL AS name, NULL AS supercategory,
  CAST(NULL AS BIGINT) AS width, CAST(NULL AS BIGINT) AS height FROM slotted
UNION ALL SELECT DISTINCT 'images', CAST(image_id AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, image_filename, NULL, {SIZE[0]}, {SIZE[1]} FROM ided
UNION ALL SELECT DISTINCT 'categories', CAST(category_id AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, category, supercategory, NULL, NULL FROM boxes
"""))
def coco_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole COCO document as lines of text, and all three of its sections read back from that text."""
    lines = export.document_lines(_export(spark, sf_dir), {})
    names = sorted(COCO_FIELDS)
    kind = (
        "id bigint, image_id bigint, bbox array<double>, area double, category_id bigint, name string, file_name string, "
        "supercategory string, width bigint, height bigint"
    )
    section = F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("part") / 3) + 1).cast("int"))
    rows = lines.where((F.col("part") % 3 == 2) & (F.col("part") < 3 * len(names))).select(
        section.alias("section"), F.from_json(F.regexp_replace("line", "^[ ,]+", ""), kind).alias("a"))
    return rows.select(
        "section", "a.id", "a.image_id", *(F.try_element_at("a.bbox", F.lit(i + 1)).alias(c) for i, c in enumerate("xywh")), "a.area", "a.category_id",
        F.coalesce("a.name", "a.file_name").alias("name"), "a.supercategory", "a.width", "a.height",
    )


@query(with_boxes("""
SELECT CAST(image_id AS BIGINT) AS time, 'id_' || CAST(id AS VARCHAR) AS individuals, x_min + width / 2 AS position_x, y_min + height / 2 AS position_y,
  width AS shape_x, height AS shape_y, true AS no_confidence FROM slotted
"""))
def track_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = dense.track_table(slotted(spark, sf_dir, "x_min", "y_min", "width", "height"))
    return tracks.withColumn("no_confidence", F.isnan("confidence")).drop("confidence")


@query("""
WITH names AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS place FROM (SELECT DISTINCT event_type FROM events))
SELECT event_id, CAST(place AS BIGINT) AS from_name, CAST(user_id AS BIGINT) AS from_number FROM events JOIN names USING (event_type)
""")
def category_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category keys that are integers stay; others count by their place among the sorted keys."""
    events = table(spark, sf_dir, "events")
    options = events.select("event_type").distinct().agg(F.collect_list("event_type").alias("options"))  # the keys of one file
    return events.join(F.broadcast(options), F.lit(True)).select(
        "event_id", B.category_number(F.col("event_type"), F.col("options")).alias("from_name"),
        B.category_number(F.col("user_id").cast("string"), F.col("options")).alias("from_number"),
    )


@query("""
SELECT event_id, CAST(0 AS BIGINT) AS of_text, user_id AS of_number, user_id AS of_digits,
  CASE WHEN value IS NULL OR isnan(value) THEN 0 ELSE CAST(trunc(value) AS BIGINT) END AS of_fraction, CAST(0 AS BIGINT) AS of_null FROM events
""")
def size_as_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as JSON has them: texts, whole numbers, digits in quotes, fractions, nothing."""
    own = F.to_json(F.struct(
        F.col("event_type").alias("text"), F.col("user_id").alias("number"), F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("digits"),
        F.col("value").alias("fraction"),
    ))
    sizes = F.from_json(own, "map<string,variant>")
    return table(spark, sf_dir, "events").select(
        "event_id", *(B.size_as_integer(F.try_element_at(sizes, F.lit(k))).alias(f"of_{k}") for k in ("text", "number", "digits", "fraction", "null")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' ELSE '' END AS name FROM lineitem")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from a map that lacks some keys."""
    names = spark.createDataFrame([("A", "accepted"), ("N", "none")], "l_returnflag string, name string")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return export.with_lookup(rows, names, "l_returnflag", "name", "").drop("l_returnflag")


@query("SELECT page_id, CASE WHEN contains(url, '/') THEN nullif(list_extract(string_split(url, '/'), 3), '') END AS host, CASE WHEN contains(url, '/') THEN list_extract(string_split(url, '/'), -1) ELSE list_extract(string_split(url, '.'), -1) END AS last FROM pages")
def filename_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.nullif(B.path_part(url, ["/"], 3), F.lit("")).alias("host"), B.path_part(url, ["/", "."], -1).alias("last")
    )


# --- regions -----------------------------------------------------------------------------------------

_LOW, _HIGH = (10.0, 20000.0), (40.0, 60000.0)
_CORNERS = [(5.0, 10000.0), (45.0, 10000.0), (45.0, 50000.0), (25.0, 30000.0), (5.0, 50000.0)]


@query(f"""
SELECT l_returnflag AS grp, count(*) AS n_boxes, count(*) FILTER (inside) AS n_inside, count(*) FILTER (inside) / count(*) AS fraction
FROM (SELECT l_returnflag, l_quantity + l_discount / 2 BETWEEN {_LOW[0]} AND {_HIGH[0]}
  AND l_extendedprice + l_tax / 2 BETWEEN {_LOW[1]} AND {_HIGH[1]} AS inside FROM lineitem) GROUP BY l_returnflag
""")
def roi_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _centers(spark, sf_dir).withColumnRenamed("l_returnflag", "grp")
    return regions.region_counts(rows, B.in_rectangle(F.col("x"), F.col("y"), _LOW, _HIGH), ["grp"])


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", B.center(F.col("l_quantity"), F.col("l_discount")).alias("x"), B.center(F.col("l_extendedprice"), F.col("l_tax")).alias("y")
    )


@query("""
SELECT count(*) AS n_boxes, count(*) FILTER (inside) AS n_inside, count(*) FILTER (inside) / count(*) AS fraction FROM (
  SELECT x BETWEEN 5 AND 45 AND y >= 10000 AND y <= 50000
    AND ((x <= 25 AND y <= 50000 - (x - 5) * 1000) OR (x >= 25 AND y <= 30000 + (x - 25) * 1000)) AS inside
  FROM (SELECT l_quantity + l_discount / 2 AS x, l_extendedprice + l_tax / 2 AS y FROM lineitem))
""")
def roi_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-cornered region with a notch."""
    return regions.region_counts(_centers(spark, sf_dir), B.in_polygon(F.col("x"), F.col("y"), _CORNERS), [])


@query("""
WITH p AS (SELECT l_quantity + l_discount / 2 AS x, l_extendedprice + l_tax / 2 AS y FROM lineitem),
e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT CAST(least(floor((x - x0) / ((x1 - x0) / 75)), 74) AS BIGINT) AS bin_x,
  CAST(least(floor((y - y0) / ((y1 - y0) / 42)), 41) AS BIGINT) AS bin_y, count(*) AS n FROM p, e GROUP BY ALL
""")
def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.occupancy(_centers(spark, sf_dir), "x", "y", (75, 42))


# --- splits ------------------------------------------------------------------------------------------

_THREE = [0.7, 0.2, 0.1]


@query(f"""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':{SEED}'), o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN p < CAST(floor({_THREE[0]}::DOUBLE * n) AS BIGINT) THEN 0
  WHEN p < CAST(floor({_THREE[0]}::DOUBLE * n) AS BIGINT) + CAST(floor({_THREE[1]}::DOUBLE * n) AS BIGINT) THEN 1 ELSE 2 END AS part FROM o
""")
def split_random_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.with_random_part(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", _THREE, SEED)


def _parts(parts: tuple[DataFrame, ...], *columns: str) -> DataFrame:
    return union_all([p.select(*columns) for p in parts]).withColumnRenamed("file_pos", "part")


def kfold_sql(rows: str, group: str, fractions: list[float]) -> str:
    folds = split.fold_count(fractions)
    small = 0 if fractions[0] <= fractions[1] else 1
    return f"""
WITH s AS ({rows}),
f AS (SELECT g, ntile({folds}) OVER (ORDER BY md5(CAST(g AS VARCHAR) || ':{SEED}'), g) - 1 AS fold FROM (SELECT DISTINCT {group} AS g FROM s))
SELECT s.*, CASE WHEN fold = {split.chosen_fold(folds, SEED)} THEN {small} ELSE {1 - small} END AS part FROM s JOIN f ON s.{group} = f.g
"""


_CUSTOMERS = "SELECT c_custkey, c_nationkey FROM customer"


@query(kfold_sql(_CUSTOMERS, "c_nationkey", [0.8, 0.2]))
def split_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return _parts(split.kfold_split(rows, "c_nationkey", [0.8, 0.2], SEED), "c_custkey", "c_nationkey")


def subset_sql(rows: str, group: str, key: str, fractions: list[float]) -> str:
    """Subsets as bit masks of the groups in their order: greatest sum up to the target, then smallest mask."""
    small = 0 if fractions[0] <= fractions[1] else 1
    return f"""
WITH s AS ({rows}),
c AS (SELECT {group} AS g, count(*) AS n, min({key}) AS first FROM s GROUP BY ALL),
o AS (SELECT g, n, row_number() OVER (ORDER BY n, first DESC) - 1 AS bit FROM c),
m AS (SELECT unnest(range(CAST(pow(2, (SELECT count(*) FROM c)) AS BIGINT))) AS mask),
t AS (SELECT mask, coalesce(sum(n) FILTER ((mask >> bit) & 1 = 1), 0) AS total FROM m, o GROUP BY mask),
best AS (SELECT mask FROM t WHERE total <= floor({min(fractions)}::DOUBLE * (SELECT count(*) FROM s)) ORDER BY total DESC, mask LIMIT 1)
SELECT s.*, CASE WHEN ((SELECT mask FROM best) >> bit) & 1 = 1 THEN {small} ELSE {1 - small} END AS part
FROM s JOIN o ON s.{group} IS NOT DISTINCT FROM o.g
"""


_DOCS, _ORDERS = "SELECT doc_id, lang FROM documents", "SELECT o_orderkey, o_orderpriority FROM orders"


@query(subset_sql(_DOCS, "lang", "doc_id", [0.3, 0.7]))
def split_apss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return _parts(split.subset_sum_split(rows, "lang", [0.3, 0.7], 0, "doc_id"), "doc_id", "lang")


@query(subset_sql(_ORDERS, "o_orderpriority", "o_orderkey", [0.55, 0.45]))
def split_apss_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return _parts(split.subset_sum_split(rows, "o_orderpriority", [0.55, 0.45], 0, "o_orderkey"), "o_orderkey", "o_orderpriority")


def trimmed_sql(rows: str, group: str, key: str, fractions: list[float], epsilon: float) -> str:
    """Ascending sums with their masks, group by group; a sum that is no more than a step above the last one kept goes."""
    small = 0 if fractions[0] <= fractions[1] else 1
    step = f"(1 + {epsilon}::DOUBLE / (2 * (SELECT count(*) FROM c)))"
    return f"""
WITH RECURSIVE s AS ({rows}),
c AS (SELECT {group} AS g, count(*) AS n, min({key}) AS first FROM s GROUP BY ALL),
o AS (SELECT g, n, row_number() OVER (ORDER BY n, first DESC) - 1 AS bit FROM c),
goal AS (SELECT CAST(floor({min(fractions)}::DOUBLE * (SELECT count(*) FROM s)) AS BIGINT) AS target, {step} AS step),
t AS (
  SELECT CAST(0 AS BIGINT) AS bit, [{{'s': CAST(0 AS BIGINT), 'g': 0, 'm': CAST(0 AS BIGINT)}}] AS held
  UNION ALL
  SELECT t.bit + 1, list_reduce(
    list_sort(list_concat(list_transform(held, lambda x: {{'s': x.s, 'g': 0, 'm': x.m}}), list_transform(
      list_filter(held, lambda x: x.s + n <= target), lambda x: {{'s': CAST(x.s + n AS BIGINT), 'g': 1, 'm': x.m | (CAST(1 AS BIGINT) << t.bit)}}))),
    lambda kept, x: CASE WHEN x.s > kept[len(kept)].s * step THEN list_append(kept, x) ELSE kept END,
    [{{'s': CAST(0 AS BIGINT), 'g': 0, 'm': CAST(0 AS BIGINT)}}])
  FROM t JOIN o ON o.bit = t.bit, goal),
best AS (SELECT held[len(held)].m AS mask FROM t ORDER BY bit DESC LIMIT 1)
SELECT s.*, CASE WHEN ((SELECT mask FROM best) >> bit) & 1 = 1 THEN {small} ELSE {1 - small} END AS part
FROM s JOIN o ON s.{group} IS NOT DISTINCT FROM o.g
"""


_STATUS = "SELECT o_orderkey, o_custkey % 17 AS site FROM orders"


@query(trimmed_sql(_STATUS, "site", "o_orderkey", [0.4, 0.6], 0.6))
def split_apss_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly equal sums are merged, so that far fewer than 2**17 are held."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 17).alias("site"))
    return _parts(split.subset_sum_split(rows, "site", [0.4, 0.6], 0.6, "o_orderkey"), "o_orderkey", "site")


@query(subset_sql(_STATUS, "site", "o_orderkey", [0.4, 0.6]))
def split_apss_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 17).alias("site"))
    return _parts(split.subset_sum_split(rows, "site", [0.4, 0.6], 0, "o_orderkey"), "o_orderkey", "site")


@query(subset_sql(_DOCS, "lang", "doc_id", [0.9, 0.1]))
def split_auto_few_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten folds but four groups: subset sum."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return _parts(split.group_split(rows, "lang", [0.9, 0.1], "doc_id", "auto", SEED), "doc_id", "lang")


@query(kfold_sql(_CUSTOMERS, "c_nationkey", [0.25, 0.75]))
def split_auto_many_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four folds and 25 groups: k-fold."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return _parts(split.group_split(rows, "c_nationkey", [0.25, 0.75], "c_custkey", "auto", SEED), "c_custkey", "c_nationkey")


def _orders_as_images(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders are images, with a variable of their own, and lines their boxes."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_quantity").alias("x_min"))
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "image_id")
    return Dataset(lines, orders.select("image_id"), lines.limit(0)).with_image_variable(orders.select("image_id", "o_orderpriority"))


def _boxes_of_parts(parts: tuple[Dataset, ...]) -> DataFrame:
    """A row per part and image: how many boxes went with it."""
    rows = [p.images.select("image_id").join(p.annotations.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left") for p in parts]
    return union_all(rows).select(F.col("file_pos").alias("part"), "image_id", F.coalesce("n", F.lit(0)).alias("n_boxes"))


def _with_lines(split_sql: str) -> str:
    return f"""
WITH p AS ({split_sql}), l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT part, o_orderkey AS image_id, coalesce(n, 0) AS n_boxes FROM p LEFT JOIN l ON l_orderkey = o_orderkey
"""


@query(_with_lines(subset_sql(_ORDERS, "o_orderpriority", "o_orderkey", [0.55, 0.45])))
def dataset_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole datasets split by an image variable: boxes go with their images."""
    ds = _orders_as_images(spark, sf_dir)
    return _boxes_of_parts(split_dataset_group_by(ds, "o_orderpriority", [0.55, 0.45], method="apss"))


@query(_with_lines(ORACLE_SQL["split_random_k"]))
def dataset_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes_of_parts(split_dataset_random(_orders_as_images(spark, sf_dir), _THREE, SEED))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def semi_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_segments(spark, sf_dir, "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def anti_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_segments(spark, sf_dir, "left_anti")


def _of_segments(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    named = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return orders.join(named.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", how).select("o_orderkey", "o_custkey")


# --- checks ------------------------------------------------------------------------------------------


@query("SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.absent') AS has_absent, json_valid(props) AS is_json FROM events")
def json_required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.try_parse_json("props")
    has = lambda key: F.coalesce(key_error(doc, [key], F.lit("")).isNull() & doc.isNotNull(), F.lit(False))
    return table(spark, sf_dir, "events").select("event_id", has("k").alias("has_k"), has("absent").alias("has_absent"), doc.isNotNull().alias("is_json"))


@query("""
SELECT count(*) FILTER (l_linenumber < 0) AS bad_annotation_id, count(*) FILTER (l_quantity < 25) AS bad_image_width,
  count(*) FILTER (l_discount * l_tax < 0) AS bad_area, count(*) FILTER (l_linenumber NOT IN (0, 1)) AS bad_iscrowd, count(*) AS n_rows FROM lineitem
""")
def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_rule_counts(table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("annotation_id"), (F.col("l_quantity") - 25).alias("image_width"),
        (F.col("l_discount") * F.col("l_tax")).alias("area"), F.col("l_linenumber").alias("iscrowd"),
    ))


_INDEXES = {
    "numbered": "p", "repeats": "l_linenumber - 1", "gaps": "2 * p", "both": "CASE WHEN p = 7 THEN 8 ELSE p END", "from one": "p + 1",
}


@query("WITH t AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS p FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS n_rows, CAST(min({x}) AS BIGINT) AS least, CAST(max({x}) AS BIGINT) AS greatest, "
    f"count(DISTINCT {x}) = count(*) AND min({x}) = 0 AND max({x}) = count(*) - 1 AS is_index FROM t" for name, x in _INDEXES.items()
))
def validate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a column number the rows from 0? One with repeats, one with gaps, one with a repeat that hides a gap."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = written(numbering.positions(rows, rows.columns, "p"), "numbered")
    parts = [index_rule(rows.select(F.expr(x).alias("x")), "x").select(F.lit(name).alias("name"), "*") for name, x in _INDEXES.items()]
    return reduce(DataFrame.unionByName, parts)


# --- documents ---------------------------------------------------------------------------------------

ORDERS_A_FILE = 2000
_FILE = f"CAST(floor(l_orderkey / {ORDERS_A_FILE}) AS INTEGER)"
_TABLE_COLUMNS = "image_width, image_height, x_min, y_min, width, height, supercategory, category, category_id"


def _coco_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_pos, file, value)``: a COCO document for each run of orders; image ids count down, boxes come by line."""
    file = F.floor(F.col("l_orderkey") / ORDERS_A_FILE).cast("int").alias("file_pos")
    rows = boxes(spark, sf_dir).withColumn("file_pos", file)
    image = F.struct((-F.col("l_orderkey")).alias("id"), F.col("image_filename").alias("file_name"), F.lit(SIZE[0]).alias("width"), F.lit(SIZE[1]).alias("height"))
    box = F.struct(*LINE, F.struct(
        (-F.col("l_orderkey")).alias("image_id"), "category_id", F.array("x_min", "y_min", "width", "height").alias("bbox"), F.col("l_linenumber").alias("id"),
    ).alias("box"))
    kind = F.struct(F.col("category_id").alias("id"), F.col("category").alias("name"), F.lit("flag").alias("supercategory"))
    docs = rows.groupBy("file_pos").agg(
        F.array_sort(F.collect_set(image)).alias("images"), F.array_sort(F.collect_list(box)).alias("boxes"), F.array_sort(F.collect_set(kind)).alias("categories"))
    value = F.to_json(F.struct("images", F.col("boxes.box").alias("annotations"), "categories"))
    return docs.select("file_pos", F.concat(F.lit("file "), F.col("file_pos").cast("string")).alias("file"), value.alias("value"))


_COCO_ROWS_SQL = f"""
file AS (
  SELECT {_FILE} AS file_pos, image_filename, CAST({SIZE[0]} AS BIGINT) AS image_width, CAST({SIZE[1]} AS BIGINT) AS image_height, x_min, y_min, width, height,
    'flag' AS supercategory, category, CAST(category_id AS BIGINT) AS category_id, {_LINE_SQL}, l_orderkey FROM boxes),
ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY file_pos ORDER BY image_filename) - 1 AS image_id,
    row_number() OVER (PARTITION BY file_pos ORDER BY {_LINE_SQL}, l_orderkey DESC) - 1 AS annotation_id FROM file)
"""


@query(with_boxes(f", {_COCO_ROWS_SQL} SELECT file_pos, CAST(annotation_id AS BIGINT) AS annotation_id, image_filename, CAST(image_id AS BIGINT) AS image_id, {_TABLE_COLUMNS} FROM ranked"))
def coco_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COCO documents parsed: images and boxes numbered within their file, sizes and names looked up."""
    return documents.document_rows(_coco_documents(spark, sf_dir), "COCO")


_KEPT_SQL = "image_filename, x_min, y_min, width, height, supercategory, category, category_id"


@query(with_boxes(f""", {_COCO_ROWS_SQL},
one AS (
  SELECT image_filename, image_width, image_height, x_min, y_min, width, height, supercategory, category, category_id, file_pos, min(annotation_id) AS source
  FROM ranked GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY image_filename, file_pos, source) - 1 AS BIGINT) AS annotation_id, image_filename,
  CAST(dense_rank() OVER (ORDER BY image_filename) - 1 AS BIGINT) AS image_id, {_TABLE_COLUMNS} FROM one
"""))
def coco_several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of many COCO documents: repeated rows gone, images and rows numbered over all."""
    return documents.several_files(documents.document_rows(_coco_documents(spark, sf_dir), "COCO"))


@query(with_boxes(f""", {_COCO_ROWS_SQL},
one AS (
  SELECT image_filename, image_id, image_width, image_height, x_min, y_min, width, height, supercategory, category, category_id, min(annotation_id) AS annotation_id
  FROM ranked WHERE file_pos = 0 GROUP BY ALL)
SELECT CAST(annotation_id AS BIGINT) AS annotation_id, image_filename, CAST(image_id AS BIGINT) AS image_id, {_TABLE_COLUMNS} FROM one
"""))
def coco_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of one COCO document: it keeps the file's own numbers, with gaps where repeated rows went."""
    docs = _coco_documents(spark, sf_dir).where("file_pos = 0")
    return documents.single_file(documents.document_rows(docs, "COCO"))


_OPTIONS = {"A": "accepted", "N": "none", "R": "returned"}


def _via_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_pos, file, value)``: a VIA document for each run of orders, an entry an order, named by its customer.

    Widths are numbers with a fraction, heights digits in quotes or words; every eighth region has no attribute.
    """
    file = F.floor(F.col("l_orderkey") / ORDERS_A_FILE).cast("int").alias("file_pos")

    def region(line):
        attributes = F.when(line["l_partkey"] % 8 == 0, F.lit("{}")).otherwise(F.format_string('{"flag": "%s", "state": "x"}', line["l_returnflag"]))
        shape = F.to_json(F.struct(
            F.lit("rect").alias("name"), *(line[c].alias(n) for c, n in (("l_quantity", "x"), ("l_extendedprice", "y"), ("l_discount", "width"), ("l_tax", "height")))))
        return F.concat(F.lit('{"shape_attributes": '), shape, F.lit(', "region_attributes": '), attributes, F.lit("}"))

    # lines and orders go to their file once, in one shuffle, and meet there
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*LINE).alias("line"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.struct("o_custkey").alias("order"))
    rows = lines.unionByName(orders, allowMissingColumns=True).withColumn("file_pos", file).repartition("file_pos")
    rows = rows.groupBy("file_pos", "l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("r"), F.collect_list("order").alias("orders"))
    rows = rows.where(F.size("r") > 0).select("file_pos", "l_orderkey", "r", F.explode("orders.o_custkey").alias("o_custkey"))
    height = F.when(F.col("l_orderkey") % 3 == 0, F.lit('"720"')).when(F.col("l_orderkey") % 3 == 1, F.lit('"tall"')).otherwise(F.lit("null"))
    entry = F.format_string(
        '"%s": {"filename": "%012d.jpg", "size": -1, "file_attributes": {"width": %s.7, "height": %s}, "regions": [%s]}',
        "l_orderkey", "o_custkey", (F.col("l_orderkey") % 5000).cast("string"), height, F.array_join(F.transform("r", region), ", "))
    docs = rows.groupBy("file_pos").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", entry.alias("entry")))).alias("e"))
    head, tail = F.lit('{"_via_img_metadata": {'), F.lit('}, "_via_attributes": {"region": {"flag": {"options": ' + json.dumps(_OPTIONS) + '}}, "file": {}}}')
    return docs.select("file_pos", F.concat(F.lit("file "), F.col("file_pos").cast("string")).alias("file"), F.concat(head, F.array_join("e.entry", ", "), tail).alias("value"))


_VIA_ROWS_SQL = f"""
WITH entry AS (
  SELECT o_orderkey AS l_orderkey, lpad(CAST(o_custkey AS VARCHAR), 12, '0') || '.jpg' AS image_filename, {_FILE.replace("l_orderkey", "o_orderkey")} AS file_pos,
    CAST(o_orderkey % 5000 AS BIGINT) AS image_width, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 720 ELSE 0 END AS BIGINT) AS image_height
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
image AS (SELECT *, rank() OVER (PARTITION BY file_pos ORDER BY image_filename) - 1 AS image_id FROM entry),
line AS (SELECT * FROM lineitem JOIN image USING (l_orderkey)),
rows AS (
  SELECT file_pos, CAST(row_number() OVER (PARTITION BY file_pos ORDER BY l_orderkey, {_LINE_SQL}) - 1 AS BIGINT) AS annotation_id, image_filename,
    CAST(image_id AS BIGINT) AS image_id, image_width, image_height, l_quantity AS x_min, l_extendedprice AS y_min, l_discount AS width, l_tax AS height,
    CASE WHEN l_partkey % 8 = 0 THEN '' ELSE 'flag' END AS supercategory,
    CASE WHEN l_partkey % 8 = 0 THEN '' WHEN l_returnflag = 'A' THEN 'accepted' WHEN l_returnflag = 'N' THEN 'none' ELSE 'returned' END AS category,
    CAST(CASE WHEN l_partkey % 8 = 0 THEN -1 WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 ELSE 3 END AS BIGINT) AS category_id FROM line)
"""


@query(f"{_VIA_ROWS_SQL} SELECT * FROM rows")
def via_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VIA documents parsed: equal filenames of a file share the first rank, sizes become integers, categories are looked up."""
    return documents.document_rows(_via_documents(spark, sf_dir), "VIA")


@query(f"""
{_VIA_ROWS_SQL},
one AS (
  SELECT {_KEPT_SQL}, min((file_pos, annotation_id, image_width, image_height)) AS f FROM rows GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY image_filename, f) - 1 AS BIGINT) AS annotation_id, image_filename,
  CAST(dense_rank() OVER (ORDER BY image_filename) - 1 AS BIGINT) AS image_id, f[3] AS image_width, f[4] AS image_height,
  x_min, y_min, width, height, supercategory, category, category_id FROM one
""")
def via_several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of many VIA documents; sizes don't tell rows apart, the first row's stay."""
    return documents.several_files(documents.document_rows(_via_documents(spark, sf_dir), "VIA"))


@query("""
WITH r AS (
  SELECT p_brand || '.jpg' AS image_filename, CAST(dense_rank() OVER (ORDER BY p_brand || '.jpg') - 1 AS BIGINT) AS image_id,
    CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS id,
    CAST(row_number() OVER (ORDER BY p_brand || '.jpg', p_partkey) - 1 AS BIGINT) AS annotation_id, p_partkey, p_retailprice, p_size FROM part)
SELECT annotation_id, image_filename, image_id, CAST(640 AS BIGINT) AS image_width, CAST(480 AS BIGINT) AS image_height, p_retailprice AS x_min,
  CAST(p_partkey AS DOUBLE) AS y_min, CAST(p_size AS DOUBLE) AS width, p_size / 2 AS height, 'kind' AS supercategory,
  'kind ' || (p_partkey % 7) AS category, CAST(p_partkey % 7 AS BIGINT) AS category_id, id FROM r
""")
def coco_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset written as one COCO file, checked, and loaded from that file again; parts are boxes, brands images."""
    kind = (F.col("p_partkey") % 7).cast("bigint")
    rows = table(spark, sf_dir, "part").select(
        F.concat("p_brand", F.lit(".jpg")).alias("image_filename"), F.lit(640).cast("bigint").alias("image_width"), F.lit(480).cast("bigint").alias("image_height"),
        F.col("p_retailprice").alias("x_min"), F.col("p_partkey").cast("double").alias("y_min"), F.col("p_size").cast("double").alias("width"),
        (F.col("p_size") / 2).alias("height"), F.lit("kind").alias("supercategory"), F.concat(F.lit("kind "), kind.cast("string")).alias("category"),
        kind.alias("category_id"),
    )
    boxes = written(numbering.numbered(rows, "image_filename", ["y_min"], place="image_id", slot="id", position="annotation_id"), "parts")
    path = to_COCO_file(Dataset(boxes, *maps(boxes)), scratch(spark, "file") + ".json")
    return from_files(path, "COCO", spark=spark).annotations


#: Faults of small COCO documents, by ``user_id % 9``: what stands for the sections, and the message that is due.
_FAULTS = {
    "images": {5: "[]", 6: '[{"id": 1, "width": 2, "height": 2}]', 8: '[{"id": 1, "file_name": "a", "width": 2, "height": 2}, {"id": 1, "file_name": "b", "width": 2, "height": 2}]'},
    "annotations": {2: "7", 3: '[{"id": 0, "image_id": 1, "bbox": [1, 2, "3", 4], "category_id": 1}]', 7: '[{"id": 0, "image_id": 1, "category_id": 1}]'},
}
_GOOD = {
    "images": '[{"id": 1, "file_name": "a", "width": 2, "height": 2}]',
    "annotations": '[{"id": 0, "image_id": 1, "bbox": [1, 2, 3, 4], "category_id": 1}]',
}


@query("""
SELECT event_id AS file_pos, 'event ' || event_id AS file, CASE user_id % 9
  WHEN 1 THEN 'Error decoding JSON data from file: event ' || event_id
  WHEN 2 THEN '7 is not of type ' || chr(39) || 'array' || chr(39) WHEN 3 THEN '"3" is not of type ' || chr(39) || 'number' || chr(39)
  WHEN 4 THEN 'Required key(s) [''categories''] not found.'
  WHEN 5 THEN 'Empty value(s) found for the required key(s) [''images''].'
  WHEN 6 THEN 'Required key(s) [''file_name''] not found for image {"height":2,"id":1,"width":2}.'
  WHEN 7 THEN 'Required key(s) [''bbox''] not found for annotation {"category_id":1,"id":0,"image_id":1}.'
  WHEN 8 THEN 'The image IDs in the input COCO file are not unique. There are 2 image entries, but only 1 unique image IDs.' END AS error
FROM events
""")
def coco_document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small document for each event, most with a fault: the first thing wrong with each."""
    fault = F.col("user_id") % 9

    def part(name: str):
        out = F.lit(_GOOD[name])
        for k, text in _FAULTS[name].items():
            out = F.when(fault == k, text).otherwise(out)
        return out

    rest = F.when(fault == 4, "").otherwise(', "categories": [{"id": 1, "name": "x"}]')
    whole = F.concat(F.lit('{"images": '), part("images"), F.lit(', "annotations": '), part("annotations"), rest, F.when(fault == 1, "").otherwise("}"))
    name = F.concat(F.lit("event "), F.col("event_id").cast("string"))
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("file_pos"), name.alias("file"), whole.alias("value"))
    return document_errors(docs, "COCO")


@query("""
SELECT event_id AS file_pos, 'event ' || event_id AS file, CASE user_id % 5
  WHEN 1 THEN 'Error decoding JSON data from file: event ' || event_id
  WHEN 2 THEN 'Required key(s) [''_via_attributes''] not found.'
  WHEN 3 THEN 'Required key(s) [''filename''] not found for k' || event_id || '.'
  WHEN 4 THEN 'Required key(s) [''height'', ''y''] not found for region 0 under k' || event_id || '.' END AS error
FROM events
""")
def via_document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = F.col("user_id") % 5
    shape = F.when(fault == 4, '"x": 1, "width": 2').otherwise('"x": 1, "y": 2.5, "width": 2, "height": 3')
    name = F.when(fault == 3, "").otherwise('"filename": "a.jpg", ')
    rest = F.when(fault == 2, "").otherwise(', "_via_attributes": {"region": {"flag": {"options": {"1": "x"}}}}')
    whole = F.concat(
        F.lit('{"_via_img_metadata": {"k'), F.col("event_id").cast("string"), F.lit('": {'), name, F.lit('"regions": [{"shape_attributes": {'), shape,
        F.lit('}, "region_attributes": {}}]}}'), rest, F.when(fault == 1, "").otherwise("}"))
    file = F.concat(F.lit("event "), F.col("event_id").cast("string"))
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("file_pos"), file.alias("file"), whole.alias("value"))
    return document_errors(docs, "VIA")
