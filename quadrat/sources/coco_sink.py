"""Writing one COCO document: sorted part files by Spark, joined by streaming."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame

from quadrat.operators.export import document_lines
from quadrat.shared import scratch


def _info() -> dict:
    now = datetime.now(UTC).strftime("%a %b %d %Y %H:%M:%S GMT%z")
    return {"date_created": now, "description": "Bounding-box annotations exported by quadrat", "version": "1.0"}


def write_parts(table: DataFrame, folder: str) -> str:
    """Text files in ``folder`` that, in the order of their names, are one COCO document."""
    lines = document_lines(table, _info())
    lines.repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("line").write.text(folder)
    return folder


def write_file(table: DataFrame, path: str) -> str:
    """One COCO JSON file at ``path``, replaced if it is there; any file system that Spark knows.

    Executors write the parts; the driver copies them one after the other through a small buffer and never
    holds the document. For very large tables ``write_parts`` leaves out the copy.
    """
    spark = table.sparkSession
    folder = write_parts(table, scratch(spark, "coco"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    parts = sorted((f.getPath() for f in fs.listStatus(source)), key=lambda p: p.getName())
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in parts:
            if part.getName().startswith("part-"):
                stream = fs.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                finally:
                    stream.close()
    finally:
        out.close()
    return path
