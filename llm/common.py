"""Shared pieces: the shared scratch folder, written-and-reread tables, byte word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z lower-cased; every other ASCII character that is neither a digit nor a lower-case letter becomes a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

BATCH_BYTES = 8 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share (``spark.checkpoint.dir``).

    Where that setting is absent, a local session, as in tests, gets a temporary folder in its place;
    on a cluster, whose executors don't share such a folder, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        base = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, with the writer's ``options``, and read it back.

    Sums per key are written before rows are joined with them, too: between two plain shuffles adaptive
    execution can split a hot key, on top of an aggregate it can't.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores in front of those that ``columns`` has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row in ``order``, from zero.

    One range sort, written; of each range only its size reaches the driver. Equal rows are placed as they come.
    """
    rows = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = written(rows.withColumn(name, F.monotonically_increasing_id()), "ranked")
    at, within = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in sorted(rows.groupBy(at.alias("part")).agg(F.count("*").alias("n")).collect()):
        starts.append((r.part, before))
        before += r.n
    first = df.sparkSession.createDataFrame(starts, "part long, first long")
    return rows.join(F.broadcast(first), at == F.col("part")).withColumn(name, F.col("first") + within).drop("part", "first")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and non-ASCII characters; null has none."""
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split() if text else []


def ddl(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after holding the session's Arrow batches to BATCH_BYTES, as rows may have very long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
