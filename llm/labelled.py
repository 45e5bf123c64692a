"""Bounded samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import fresh


def sample_ids(labels: DataFrame, column: str, bound: int, *more: str) -> tuple[DataFrame, dict[int, int]]:
    """``(doc_id, y)``, and the least of each of the columns ``more``, of at most ``bound`` rows of each class in the order of a hash, and counts of all.

    Rows with a null id or label don't count; of repeated ids the least label does.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    rows = rows.groupBy("doc_id").agg((F.min(column) > 0).cast("int").alias("y"), *(F.min(c).alias(c) for c in more))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)]
    return part[0].unionByName(part[1]), counts


def labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``y``, the further columns of ``ids`` and those of ``docs`` of the sampled documents, one row for each id.

    Of several rows of an id the one of least hash counts, so the sample stays within its bound; it is a
    minimum, combined before the shuffle. Ids are at most twice the bound, so they may be broadcast.
    """
    (name,) = fresh(docs.columns, "sampled")
    rows = docs.join(F.broadcast(ids.withColumnRenamed("doc_id", name)), F.col("doc_id") == F.col(name)).drop(name)
    first = F.min(F.struct(F.xxhash64(*docs.columns).alias("hash"), *docs.columns)).alias("first")
    own = [c for c in ids.columns if c != "doc_id"]
    return rows.groupBy(F.col("doc_id").alias(name), *own).agg(first).select(*own, *(F.col("first")[c].alias(c) for c in docs.columns))
