from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from llm.common import fresh, ranked, scratch


def test_no_local_scratch_folder_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(session, "x")


def test_fresh_names():
    assert fresh(["a", "_A", "b"], "A", "b", "b", "c") == ["__A", "_b", "__b", "c"]


def test_ranked(spark):
    values = [None, "b", "é", "a", "Z", "bb", "日"] + [f"k{i}" for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = {r.v: r.place for r in ranked(df, [F.col("v").isNull(), F.col("v")], "place").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, key=lambda v: (v is None, v or "")))}
    assert ranked(df.limit(0), [F.col("v")], "place").collect() == []
