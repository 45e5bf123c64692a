"""Bounding-box image annotations on Spark: load, reshape, export and split."""

from quadrat.dataset import (
    Dataset,
    from_dense,
    from_files,
    maps,
    split_dataset_group_by,
    split_dataset_random,
    table_from_files,
    to_COCO_file,
    to_COCO_table,
)

__all__ = [
    "Dataset", "from_dense", "from_files", "maps", "split_dataset_group_by", "split_dataset_random", "table_from_files",
    "to_COCO_file", "to_COCO_table",
]
