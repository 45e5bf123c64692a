"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Where that is unset, a local session, as in tests, gets a temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        base = tempfile.mkdtemp(prefix="quadrat-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lost executors don't bring its plan back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FEW = 100_000  # rows of a lookup table that is broadcast


def lookup(names: DataFrame, name: str = "lookup") -> DataFrame:
    """``names``, written once, and broadcast to a join if it has few rows; each may have a large part of the other side."""
    names = written(names, name)
    return F.broadcast(names) if names.limit(FEW + 1).count() <= FEW else names


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores in front of those that ``columns`` has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
