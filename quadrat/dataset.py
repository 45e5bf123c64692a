"""A loaded dataset and what users call: load, export, split."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat import schema
from quadrat.operators import dense as _dense
from quadrat.operators import split as _split
from quadrat.operators.dedup import last_value
from quadrat.operators.export import export_table, with_lookup
from quadrat.shared import written
from quadrat.sources import coco_sink, documents
from quadrat.sources.checks import AnnotationsDataset, check_documents, check_export, check_table, checked_input, checked_output


@dataclass(frozen=True)
class Dataset:
    """Annotations in long form, one row per box, with the images and categories that occur in them."""

    annotations: DataFrame
    images: DataFrame
    categories: DataFrame
    attrs: dict = field(default_factory=dict)

    @property
    def data_vars(self) -> dict[str, set[str]]:
        """The variables that the columns make up, and their dimensions."""
        have, out = set(self.annotations.columns), {}
        per_box = {"id"} & have
        for name, columns in (("position", {"x_min", "y_min", "width", "height"}), ("shape", {"width", "height"})):
            if columns <= have:
                out[name] = {"image_id", "space", *per_box}
        for name, columns in (("category", {"category_id", "category"}), ("confidence", {"confidence"})):
            if columns <= have:
                out[name] = {"image_id", *per_box}
        if {"image_width", "image_height"} <= have:
            out["image_shape"] = {"image_id", "space"}
        return out

    def dense(self) -> DataFrame:
        """A row per image with padded arrays."""
        return _dense.dense_view(self.annotations)

    def tracks(self) -> DataFrame:
        """A row per time (image) and individual (slot), with centres, sizes and an unknown confidence."""
        return _dense.track_table(self.annotations)

    def with_image_variable(self, values: DataFrame) -> Dataset:
        """The dataset with further columns of ``images``, joined by ``image_id``."""
        return replace(self, images=self.images.join(values, "image_id", "left"))

    def of_images(self, images: DataFrame) -> Dataset:
        return replace(self, images=images, annotations=self.annotations.join(images.select("image_id"), "image_id", "left_semi"))


def maps(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(image_id, image_filename)`` and ``(category_id, category)``; of several names the last counts.

    Without category columns the second is empty.
    """
    images = last_value(boxes, "image_id", "image_filename", ["annotation_id"])
    if {"category_id", "category"} <= set(boxes.columns):
        return images, last_value(boxes, "category_id", "category", ["annotation_id"]).orderBy("category_id")
    return images, boxes.sparkSession.createDataFrame([], "category_id bigint, category string")


@checked_output(check_table)
def table_from_files(spark: SparkSession, file_paths: str | list[str], format: str) -> DataFrame:
    """The canonical annotation table of one file or of a list of files, checked and written once.

    A list, even of one file, numbers images over all files by filename; a single path keeps the file's own numbers.
    """
    documents.check_format(format)
    several = isinstance(file_paths, (list, tuple))
    docs = documents.read_documents(spark, [str(p) for p in (file_paths if several else [file_paths])])
    check_documents(docs, format)
    rows = documents.document_rows(docs, format)
    return written(documents.several_files(rows) if several else documents.single_file(rows), "annotations")


@checked_output(AnnotationsDataset)
def from_files(
    file_paths: str | list[str], format: str, images_dirs: str | list[str] | None = None, spark: SparkSession | None = None
) -> Dataset:
    """One deduplicated dataset of VIA or COCO files. Columns without any defined value are dropped."""
    spark = spark or SparkSession.active()
    boxes = _dense.without_empty_columns(table_from_files(spark, file_paths, format))
    images, categories = maps(boxes)
    if {"image_width", "image_height"} <= set(boxes.columns):
        _dense.check_image_sizes(boxes)
    listed = [str(p) for p in file_paths] if isinstance(file_paths, (list, tuple)) else str(file_paths)
    attrs = {"annotation_files": listed, "annotation_format": format}
    if images_dirs is not None:
        attrs["images_directories"] = images_dirs
    return Dataset(_dense.with_slots(boxes), images, categories, attrs)


@checked_output(check_export)
@checked_input(AnnotationsDataset)
def to_COCO_table(dataset: Dataset) -> DataFrame:
    """The exportable table of a dataset: names come from its maps, boxes with an undefined side are left out."""
    boxes = dataset.annotations.dropna("any", subset=["x_min", "y_min", "width", "height"])
    boxes = with_lookup(boxes, dataset.images, "image_id", "image_filename")
    return export_table(with_lookup(boxes, dataset.categories, "category_id", "category", ""))


@checked_input(AnnotationsDataset)
def to_COCO_file(dataset: Dataset, output_filepath: str) -> str:
    """Write one COCO JSON file and check it by reading it again."""
    path = coco_sink.write_file(to_COCO_table(dataset), str(output_filepath))
    check_documents(documents.read_documents(dataset.annotations.sparkSession, [path]), "COCO")
    return path


def from_dense(dense: DataFrame, images: DataFrame, categories: DataFrame) -> Dataset:
    """A dataset of a padded view, after changes to it."""
    boxes = _dense.long_view(dense)
    if "image_shape" in boxes.columns:
        boxes = boxes.withColumns({"image_width": F.col("image_shape")[0], "image_height": F.col("image_shape")[1]})
    boxes = with_lookup(boxes, images, "image_id", "image_filename")
    boxes = with_lookup(boxes, categories, "category_id", "category")
    keep = [c for c in (*schema.COLUMNS, "id") if c in boxes.columns]
    return Dataset(boxes.select(*keep), images, categories)


def split_dataset_group_by(
    dataset: Dataset, group_by_var: str, list_fractions: list[float], samples_coordinate: str = "image_id",
    method: str = "auto", seed: int = 42, epsilon: float = 0,
) -> tuple[Dataset, Dataset]:
    """Two datasets that share no value of ``group_by_var``, a column of ``images``."""
    parts = _split.group_split(dataset.images, group_by_var, list_fractions, samples_coordinate, method, seed, epsilon)
    return tuple(dataset.of_images(p) for p in parts)


def split_dataset_random(
    dataset: Dataset, list_fractions: list[float], seed: int = 42, samples_coordinate: str = "image_id", legacy_order: bool = False
) -> tuple[Dataset, ...]:
    """A dataset per fraction, of images dealt at random."""
    parts = _split.random_split(dataset.images, list_fractions, seed, samples_coordinate, legacy_order)
    return tuple(dataset.of_images(p) for p in parts)
