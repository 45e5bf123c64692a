"""Annotation files as they arrive, with Structured Streaming: an addition of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrat.sources.checks import document_errors
from quadrat.sources.documents import check_format, document_rows


def ingest(spark: SparkSession, folder: str, format: str, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the rows of new files in ``folder`` to the Parquet folder ``table``, bad files' errors to ``table``_errors.

    A batch is written to a folder of its own, by overwriting, so a batch that is run again doesn't
    repeat rows. Rows carry ``file``; ids are those of their file.
    """
    check_format(format)

    def write(batch: DataFrame, number: int) -> None:
        docs = batch.withColumn("file_pos", F.xxhash64("file"))
        errors = document_errors(docs, format)
        bad = errors.where("error is not null").select("file", "error")
        good = docs.join(errors.where("error is null").select("file"), "file", "left_semi")
        names = docs.select("file_pos", "file")
        rows = document_rows(good, format).join(names, "file_pos").drop("file_pos")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{table}_errors/batch={number}")

    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    files = files.select("value", F.col("_metadata.file_path").alias("file"))
    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
