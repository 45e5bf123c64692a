"""Splits, numbering and column expressions, with random inputs against plain versions."""

import itertools
import logging
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quadrat import Dataset, split_dataset_group_by, split_dataset_random
from quadrat.functions import boxes as B
from quadrat.operators import dense, numbering, regions, split
from quadrat.operators.dedup import keep_first
from quadrat.operators.export import with_lookup
from quadrat.operators.split import group_folds, group_split, random_split, subset_sum
from quadrat.schema import TYPES, check_property_names, property_names
from quadrat.shared import scratch
from quadrat.sources.checks import index_rule


@pytest.mark.parametrize(
    "counts, target, epsilon, want",
    [
        ([("x", 41), ("y", 17)], 16, 0, ([], 0)),
        ([("x", 41), ("y", 17)], 40, 0, (["y"], 17)),
        ([(9, 4), (8, 4), (7, 6)], 10, 0, ([9, 7], 10)),
        ([(None, 7), ("z", 12), ("w", 20)], 38, 0, (["z", "w"], 32)),
        ([(1, 100), (2, 101), (3, 300)], 301, 0.5, ([3], 300)),
        ([], 3, 0, ([], 0)),
    ],
)
def test_subset_sum(counts, target, epsilon, want):
    got = subset_sum(counts, target, epsilon)
    assert (got["ids"], got["sum"]) == want


def test_subset_sum_has_a_bound(monkeypatch):
    monkeypatch.setattr(split, "MAX_SUMS", 3000)
    counts = [(k, 2**k) for k in range(12)]
    with pytest.raises(ValueError, match="larger epsilon"):
        subset_sum(counts, 4000, 1e-6)
    assert subset_sum(counts, 4000, 0.9)["sum"] >= 400 and subset_sum(counts, 4000)["sum"] == 4000


def test_subset_sum_is_the_best_or_within_its_bound():
    draw = random.Random(1)
    for _ in range(300):
        counts = [(k, draw.randint(1, 30)) for k in range(draw.randint(1, 8))]
        target = draw.randint(1, sum(n for _, n in counts))
        masks = range(1 << len(counts))
        sums = {m: sum(n for k, n in counts if m >> k & 1) for m in masks}
        best = min((m for m in masks if sums[m] <= target), key=lambda m: (-sums[m], m))
        got = subset_sum(counts, target)
        assert got == {"sum": sums[best], "ids": [k for k, _ in counts if best >> k & 1]}
        near = subset_sum(counts, target, 0.3)
        assert (1 - 0.3) * sums[best] <= near["sum"] <= target and near["sum"] == sum(dict(counts)[k] for k in near["ids"])


def samples(spark, groups):
    return spark.createDataFrame(list(enumerate(groups)), "image_id bigint, grp string")


def ids(df):
    return sorted(r[0] for r in df.select("image_id").collect())


@pytest.mark.parametrize("fractions, sizes", [([0.7, 0.2, 0.1], [70, 20, 10]), ([1 / 3, 1 / 3, 1 / 3], [33, 33, 34]), ([0.8, 0.2], [80, 20])])
def test_random_split(spark, fractions, sizes):
    rows = samples(spark, ["x"] * 100)
    parts = [ids(p) for p in random_split(rows, fractions)]
    assert [len(p) for p in parts] == sizes and sorted(itertools.chain(*parts)) == list(range(100))
    assert parts == [ids(p) for p in random_split(rows.repartition(3), fractions)]
    assert parts != [ids(p) for p in random_split(rows, fractions, seed=1)]


def test_random_split_in_legacy_order(spark):
    rows = samples(spark, ["x"] * 100)
    assert [p.count() for p in random_split(rows, [0.7, 0.2, 0.1], legacy_order=True)] == [10, 20, 70]
    assert [p.count() for p in random_split(rows.where("image_id < 3"), [0.666, 0.334], legacy_order=True)] == [2, 1]


def test_group_split_by_subset_sum(spark):
    rows = samples(spark, "100222000001")
    large, small = group_split(rows, "grp", [0.8, 0.2])
    assert (large.count(), small.count()) == (10, 2) and ids(small) == [0, 11]
    two, one = group_split(rows, "grp", [0.2, 0.8], method="apss")
    assert (ids(two), ids(one)) == (ids(small), ids(large))


def test_group_split_by_folds(spark):
    rows = samples(spark, [str(k // 10) for k in range(100)])
    large, small = group_split(rows, "grp", [0.8, 0.2])
    assert (large.count(), small.count()) == (80, 20)
    assert not large.select("grp").intersect(small.select("grp")).count()
    assert ids(small) == ids(group_split(rows.repartition(5), "grp", [0.8, 0.2])[1])
    assert any(ids(small) != ids(group_split(rows, "grp", [0.8, 0.2], seed=s)[1]) for s in (1, 2, 3))


def test_null_is_a_group(spark):
    rows = samples(spark, [None, None, "a", "a", "a", "a", "b", "b", "b", "b"])
    for method in ("apss", "kfold"):
        parts = group_split(rows, "grp", [0.6, 0.4], method=method)
        assert sorted(ids(parts[0]) + ids(parts[1])) == list(range(10))


def test_group_folds_have_equal_numbers_of_groups(spark):
    folds = group_folds(samples(spark, "abcdefg"), "grp", 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [3, 2, 2]
    with pytest.raises(ValueError, match="2 groups into 3 folds"):
        group_folds(samples(spark, "ab"), "grp", 3)


@pytest.mark.parametrize(
    "fractions, message",
    [([0.2, 0.2], "must sum to 1"), ([0.2, 0.4, 0.4], "only two elements"), ([1.2, -0.2], "between 0 and 1"), ([0.0, 1.0], "fraction of 0")],
)
def test_group_split_errors(spark, fractions, message):
    with pytest.raises(ValueError, match=message):
        group_split(samples(spark, "ab"), "grp", fractions)


def test_more_split_errors(spark):
    rows = samples(spark, "ab")
    with pytest.raises(ValueError, match="must be 1-dimensional along image_id"):
        group_split(rows.withColumn("grp", F.array("grp")), "grp", [0.5, 0.5])
    with pytest.raises(ValueError, match="Unknown method: none"):
        group_split(rows, "grp", [0.5, 0.5], method="none")
    for fractions, message in (([1.0], "at least two"), ([1.2, -0.2], "between 0 and 1"), ([0.1, 0.2], "sum to 1")):
        with pytest.raises(ValueError, match=message):
            random_split(rows, fractions)


def test_empty_parts_warn(spark, caplog):
    rows = samples(spark, "abb")
    with caplog.at_level(logging.WARNING):
        random_split(rows, [0.9, 0.05, 0.05])
    assert "no samples" in caplog.text
    caplog.clear()
    with caplog.at_level(logging.INFO):
        large, small = group_split(rows, "grp", [0.9, 0.1])
    assert "Even the smallest group" in caplog.text and "no samples" in caplog.text and "by subset sum" in caplog.text
    assert (large.count(), small.count()) == (3, 0)


def test_dataset_splits(spark):
    boxes = spark.createDataFrame([(k // 2, k) for k in range(20)], "image_id bigint, annotation_id bigint")
    images = samples(spark, [str(k % 5) for k in range(10)])
    ds = Dataset(boxes, images.select("image_id"), boxes.limit(0)).with_image_variable(images)
    large, small = split_dataset_group_by(ds, "grp", [0.8, 0.2])
    assert (large.annotations.count(), small.annotations.count()) == (16, 4)
    parts = split_dataset_random(ds, [0.5, 0.5])
    assert sorted(ids(parts[0].images) + ids(parts[1].images)) == list(range(10)) and parts[0].annotations.count() == 10


def test_numbers_of_values(spark):
    values = ["b", None, "a", "b", "é", "B", "b", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    order = sorted(set(values), key=lambda v: (v is not None, v or ""))
    full = sorted(values, key=lambda v: (v is not None, v or ""))
    got = {r["v"]: (r["n"], r["image_id"]) for r in numbering.value_ids(df, "v").collect()}
    assert got == {v: (values.count(v), order.index(v)) for v in order}
    gaps = {r["v"]: r["image_id"] for r in numbering.value_ids(df, "v", gaps=True).collect()}
    assert gaps == {v: full.index(v) for v in order}


def test_numbers_of_nothing(spark):
    none = spark.createDataFrame([], "v string, annotation_id bigint, image_id bigint")
    assert numbering.value_ids(none, "v", gaps=True).collect() == [] and numbering.slots(none, "v", ["annotation_id"]).collect() == []
    assert dense.without_empty_columns(none).columns == none.columns and numbering.positions(none, ["v"]).collect() == []


def test_slots_of_a_hot_group(spark, monkeypatch):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as g", "cast(id as bigint) as o")
    for big in (1 << 20, 1000):  # within one task, and by ranges
        monkeypatch.setattr(numbering, "BIG", big)
        rows = numbering.slots(df, "g", ["o"])
        assert rows.count() == 5000
        got = rows.where("g is null or g = 7").orderBy("g", "o").collect()
        for value in (None, 7):
            assert [r["id"] for r in got if r["g"] == value] == list(range(sum(r["g"] == value for r in got)))


def test_numbers_with_clashing_names(spark, monkeypatch):
    names = ["at", "part", "offset", "size", "rank", "start", "inside", "big", "place", "first"]
    df = spark.createDataFrame([(k % 7, k, *([f"v{k}"] * len(names))) for k in range(200)], ", ".join(["g int", "o int", *(f"{n} string" for n in names)]))
    for big in (1 << 20, 10):
        monkeypatch.setattr(numbering, "BIG", big)
        got = numbering.numbered(df, "g", ["o"], place="image_id", slot="id", position="annotation_id").collect()
        assert {(r.o, r.image_id, r.id) for r in got} == {(k, k % 7, k // 7) for k in range(200)}
        assert sorted(r.annotation_id for r in got) == list(range(200)) and all(r[n] == f"v{r.o}" for r in got for n in names)


def test_keep_first_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 3, "x"), (None, 2, "y"), ("a", 1, None), ("a", 1, None)], "k string, o int, v string")
    assert sorted(map(tuple, keep_first(df, ["k"], ["o"]).collect()), key=repr) == [("a", 1, None), (None, 2, "y")]


def test_expressions(spark):
    df = spark.createDataFrame([("a\\b\\c.jpg",), ("d/e.jpg",), ("f",), (None,)], "f string")
    got = df.select(B.path_part(F.col("f"), ["\\", "/"], -2)).collect()
    assert [r[0] for r in got] == ["b", "d", None, None]
    keys = spark.createDataFrame([("crab",), (" 2 ",), ("1.0",), ("x",), (None,)], "k string")
    got = keys.select(B.category_number(F.col("k"), F.array(F.lit("fish"), F.lit("crab")))).collect()
    assert [r[0] for r in got] == [1, 2, None, None, None]


def test_few_names_are_looked_up_without_a_shuffle(spark):
    rows = spark.range(100).selectExpr("id", "id % 3 as k")
    out = with_lookup(rows, spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string"), "k", "name", "")
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.select("id", "k", "name").collect())) == [(i, i % 3, ("a", "b", "")[i % 3]) for i in range(100)]


def test_polygon(spark):
    nan = float("nan")
    points = [(1.0, 1.0), (0.0, 0.0), (2.0, 1.0), (5.0, 5.0), (4.0, 1.0), (nan, 1.0), (None, 1.0), (2.0, 3.0), (2.0, 2.0)]
    df = spark.createDataFrame(points, "x double, y double")
    notched = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]
    got = [r[0] for r in df.select(B.in_polygon(F.col("x"), F.col("y"), notched)).collect()]
    assert got == [True, True, True, False, True, False, False, False, True]
    assert got[0] and [r[0] for r in df.select(B.in_polygon(F.col("x"), F.col("y"), notched[::-1])).collect()] == got


def test_points_on_a_sloping_edge(spark):
    """Of points whose coordinates are rounded, those at the edge's height are on it."""
    df = spark.createDataFrame([(8.005, 46995.0), (12.005, 42995.0), (8.005, 46995.01), (25.0, 30000.0), (45.0, 50000.0), (5.0, 50000.0)], "x double, y double")
    corners = [(5.0, 10000.0), (45.0, 10000.0), (45.0, 50000.0), (25.0, 30000.0), (5.0, 50000.0)]
    for c in (corners, corners[::-1]):
        assert [r[0] for r in df.select(B.in_polygon(F.col("x"), F.col("y"), c)).collect()] == [True, True, False, True, True, True]


def test_occupancy_of_nothing_and_of_one_point(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0)], "x double, y double")
    assert regions.occupancy(df.where("y > 5"), "x", "y", (3, 3)).collect() == []
    assert [tuple(r) for r in regions.occupancy(df, "x", "y", (3, 3)).collect()] == [(0, 0, 1)]


def test_property_names():
    rules = {"properties": {"a": {}, "b": {"properties": {"b1": {}}}, "c": {"items": {"properties": {"c1": {}, "c2": {}}}}}}
    assert property_names(rules) == ["a", "b", "b/b1", "c", "c/c1", "c/c2"]
    check_property_names(["images", "images/id"], TYPES["COCO"])
    with pytest.raises(ValueError, match=r"Required key\(s\) \['d', 'e'\] not found in schema\."):
        check_property_names(["e", "d", "a"], rules)


def test_no_local_scratch_folder_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(session, "x")


def test_columns_may_have_any_name(spark):
    names = ["part", "_part", "key", "order", "place", "group", "first", "n"]
    rows = spark.createDataFrame([(i, i % 5, *(["x"] * len(names))) for i in range(40)], "image_id int, fold int, " + ", ".join(f"{c} string" for c in names))
    parts = split.random_split(rows, [0.5, 0.25, 0.25])
    assert [p.columns for p in parts] == [rows.columns] * 3 and [p.count() for p in parts] == [20, 10, 10]
    for method in ("kfold", "apss"):
        small, rest = split.group_split(rows, "fold", [0.2, 0.8], method=method)
        assert small.columns == rows.columns and small.count() == 8 and rest.count() == 32
        assert not {r["fold"] for r in small.collect()} & {r["fold"] for r in rest.collect()}
    for c in ("group", "n", "first"):
        a, b = split.group_split(rows.withColumn(c, rows["fold"]), c, [0.4, 0.6], method="apss")
        assert (a.count(), b.count()) == (16, 24)
    got = keep_first(rows.withColumnRenamed("n", "__first"), ["fold"], ["image_id"])
    assert sorted(r["image_id"] for r in got.collect()) == [0, 1, 2, 3, 4] and "__first" in got.columns


@pytest.mark.parametrize("kept", [256 << 20, 1])
def test_exact_subset_sums(monkeypatch, kept):
    """The greatest sum; of equal ones the subset that is least as a number with a bit per count."""
    monkeypatch.setattr(split, "KEPT_BYTES", kept)
    rnd = random.Random(0)
    for _ in range(200):
        counts, target = [(f"g{i}", rnd.randint(1, 20)) for i in range(rnd.randint(1, 9))], rnd.randint(0, 80)
        total = lambda mask: sum(n for i, (_, n) in enumerate(counts) if mask >> i & 1)  # noqa: B023, E731
        best = min((-total(mask), mask) for mask in range(1 << len(counts)) if total(mask) <= target)
        assert split.subset_sum(counts, target) == {"sum": -best[0], "ids": [g for i, (g, _) in enumerate(counts) if best[1] >> i & 1]}


def test_many_groups_and_samples():
    rnd = random.Random(2)
    counts = [(i, rnd.randint(1, 2000)) for i in range(3000)]
    got = split.subset_sum(counts, 1_000_000)
    assert got["sum"] == sum(counts[i][1] for i in got["ids"]) == 1_000_000
    with pytest.raises(ValueError, match="kfold"):
        split.subset_sum([(0, 1), (1, split.MAX_TARGET)], split.MAX_TARGET + 1)


@pytest.mark.parametrize(
    "values, want",
    [([2, 0, 1], True), ([], True), ([0, 1, 1, 3], False), ([0, 2], False), ([1, 2], False), ([0, None], False), ([0, 1, 1, 2, 4], False), ([-1, 0], False)],
)
def test_index_rule(spark, values, want):
    row = index_rule(spark.createDataFrame([(v,) for v in values], "annotation_id long")).first()
    assert (row["is_index"], row["n_rows"]) == (want, len(values))


@pytest.mark.parametrize("digits", [(1, 1), (4, 2)])
@pytest.mark.parametrize("sizes", [[3, 4, 5], [0, 12, 0], [1, 0, 11], [12], [2, 2, 2, 2, 2, 2]])
@pytest.mark.parametrize("keys", [[*range(11), None], [7] * 5 + [1, 2, None] + [None] * 2 + [3] * 2, ["a"] * 12])
def test_parts_by_selection_are_those_of_a_sort(spark, monkeypatch, digits, sizes, keys):
    monkeypatch.setattr(split, "FIRST_DIGITS", digits[0])
    monkeypatch.setattr(split, "MORE_DIGITS", digits[1])
    rows = spark.createDataFrame([(None if k is None else str(k), i) for i, k in enumerate(keys)], "k string, place int")
    got = split.in_parts(rows, "k", 5, lambda n: sizes, "order")
    assert got.columns == ["k", "place", "order"]
    ordered = [r.k for r in rows.orderBy(split._key("k", 5)).collect()]
    want = list(zip(ordered, itertools.chain.from_iterable([part] * n for part, n in enumerate(sizes))))
    assert sorted(((r.k, r.order) for r in got.collect()), key=str) == sorted(want, key=str)


def test_splits_move_no_rows(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    parts = split.with_random_part(rows, "k", [0.2, 0.3, 0.5])
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    assert [r["count"] for r in parts.groupBy("part").count().orderBy("part").collect()] == [200, 300, 500]
    assert split.with_random_part(rows.limit(0), "k", [0.5, 0.5]).count() == 0
