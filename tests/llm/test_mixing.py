import random
import re

import pytest
from pyspark.sql import functions as F

from llm import mixing as m


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_pivot_keeps_mass_and_leaves_one():
    rnd = random.Random(1)
    for _ in range(200):
        rows = [(i, rnd.randint(1, 50), rnd.choice([0.0, 1.0, rnd.random(), 0.5])) for i in range(rnd.randint(0, 40))]
        p = m.pivot(rows, seed=rnd.randrange(99))
        assert sum(0 < x < 1 for x in p) <= 1 and all(0 <= x <= 1 for x in p)
        assert sum(r[1] * x for r, x in zip(rows, p)) == pytest.approx(sum(r[1] * r[2] for r in rows))


def test_pivot_keeps_expectations():
    rows = [(0, 3, 0.2), (1, 7, 0.6), (2, 5, 0.5)]
    mean = [sum(x) / 20_000 for x in zip(*(m.pivot(rows, seed=s) for s in range(20_000)))]
    assert mean == pytest.approx([0.2, 0.6, 0.5], abs=0.02)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET", 10)
    monkeypatch.setattr(m, "FAN_IN", 3)
    rnd = random.Random(3)
    names = ["a", "B", "é", "zz", None, "tiny", "日"]
    rows = [(i, "wörd\x0bx " * rnd.randint(0, 30), rnd.choices(names, [50, 5, 5, 20, 10, 1, 9])[0], "x") for i in range(900)]
    rows += [(1000, None, "a", "x"), (1001, "", "only blank", "x"), (1002, "w " * 30_000, "a", "x"), (3, rows[3][1], rows[3][2], "x"), (None, "no id", "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = m.taken(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, source = plain_targets(sizes), {r[0]: r[2] for r in rows}
    taken, largest = {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s], largest[s] = taken.get(s, 0) + r.taken, max(largest.get(s, 0), r.size)
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in want)
    assert sorted(map(str, got)) == sorted(map(str, m.taken(df.repartition(7)).collect()))
    mix = m.mixed(df)
    assert mix.columns == df.columns
    words = {r.source: r.n for r in mix.groupBy("source").agg(F.sum(m.size_of()).alias("n")).collect()}
    assert words == {s: n for s, n in taken.items() if n}


def test_empty(spark):
    assert m.taken(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_targets(spark):
    rnd = random.Random(8)
    for k in range(4):
        sizes = {f"s{i}": rnd.choice([0, 1, 5, 100, 1000, 50_000]) + rnd.randint(0, 9) for i in range(k * 3 + 1)} | {None: 7}
        got = m.targets(spark.createDataFrame(list(sizes.items()), "source string, words long")).collect()
        assert {r.source: r.target for r in got} == pytest.approx(plain_targets(sizes))


def test_null_ids_are_dealt_and_names_may_clash(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET", 16)
    rows = [(None, "w " * (i + 1), "a", i, i) for i in range(300)] + [(i, "w " * 40, "b", i, i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, __words long")
    units = docs.select("doc_id", m.size_of().alias("size"))
    assert units.where("doc_id is null").groupBy(F.pmod(F.xxhash64("doc_id", "size", F.lit(m.SEED + 1)), F.lit(19))).count().agg(F.max("count")).first()[0] < 60
    mix = m.mixed(docs)
    assert mix.columns == docs.columns
    known = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in mix.collect()} <= known
    got = {r.source: r.n for r in mix.groupBy("source").agg(F.sum(m.size_of()).alias("n")).collect()}
    assert all(abs(got[s] - t) <= 300 for s, t in plain_targets({"a": 300 * 301 // 2, "b": 12_000}).items())


@pytest.mark.parametrize("at_once", [1 << 16, 100])
def test_equal_rows_meet_the_target(spark, monkeypatch, at_once):
    monkeypatch.setattr(m, "AT_ONCE", at_once)
    text = "w " * 10
    rows = [(None, text, "a", i) for i in range(1000)] + [(i, text, "b", i) for i in range(1000)] + [(7, text if i % 2 else text.upper(), "c", i % 3) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, u1 int").repartition(5)
    got = m.taken(docs).collect()
    want = plain_targets({"a": 10_000, "b": 10_000, "c": 10_000})
    by_target = {t: s for s, t in want.items()}
    sums, most = {}, {}
    for r in got:
        s = next(s for t, s in by_target.items() if t == pytest.approx(r.target))
        sums[s], most[s] = sums.get(s, 0) + r.taken, max(most.get(s, 0), r.taken)
    assert len(got) == 3000 and all(abs(sums[s] - want[s]) <= 10 for s in want) and max(most.values()) <= 30
    mix = m.mixed(docs)
    assert mix.columns == docs.columns
    assert {r.source: 10 * r.n for r in mix.groupBy("source").agg(F.count("*").alias("n")).collect()} == sums
    assert max(r["n"] for r in mix.where("source = 'b'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()) <= 3
