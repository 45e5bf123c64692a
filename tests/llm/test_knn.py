import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import knn as n

KIND = "vec_id long, embedding array<double>, h1 string, cell int"


def whole(v):
    return [int(np.floor(1024 * float(x))) for x in v] if abs(max(v, default=0)) < 1e300 else None


def plain(rows, asked, k=10):
    fit = [(i, whole(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(fit):
        if q is None or not asked(q):
            continue
        others = [(-max(min(sum(x * y for x, y in zip(u, w)), n.HIGH), n.LOW), i is None, i) for b, (i, w) in enumerate(fit) if a != b and len(u) == len(w)]
        others.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(others[:k])]
    return sorted(out, key=str)


def got(spark, rows, asked, k=10):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    return sorted((tuple(r) for r in n.top_k(df, asked, k).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many cells, split tiles, split groups of queries
        for name, value in (("PIVOTS", 5), ("SAMPLE", 40), ("QUERIES", 7), ("TILE", 30), ("STEP", 8)):
            monkeypatch.setattr(n, name, value)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 12)) * rng.choice([0.2, 1, 3], size=(9, 1))
    rows = [(i, (centres[i % 9] + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.5])).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # a hot vector, some of them queries
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[0][1]), (None, rows[7][1]), (20, None), (30, [None] + [1.0] * 11), (40, [float("nan")] * 12)]
    rows += [(50, [float("inf")] * 12), (60, []), (61, []), (70, [1.0, 2.0]), (80, [0.5, -0.25]), (90, [0.0, 0.0]), (100, [1e200, -1e200]), (110, [1e9, 3e9, 7.0]), (120, [2e9, 1e9, -1.0])]
    assert got(spark, rows, F.col("vec_id") % 10 == 0) == plain(rows, lambda i: i % 10 == 0)


def test_few_rows_and_ties(spark):
    rows = [(i, [0.0, 0.0]) for i in range(0, 30)] + [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (14, [1.0, 0.0])]
    assert got(spark, rows, F.col("vec_id") % 7 == 0, 3) == plain(rows, lambda i: i % 7 == 0, 3)
    assert got(spark, [(0, [1.0])], F.lit(True)) == []


def test_empty(spark):
    assert got(spark, [], F.lit(True)) == []


def test_summaries_leave_out_only_what_cannot_be_an_answer():
    rng = np.random.default_rng(3)
    left_out = 0
    for _ in range(30):
        x = n.integers(rng.normal(size=(6, 8))[rng.integers(0, 6, 300)] * 4 + rng.normal(size=(300, 8)) * 0.02)
        p = n.pivots(x, 6)
        cell, far = n.nearest(x, p)
        queries = np.flatnonzero(rng.random(300) < 0.1)
        own = np.unique(cell[queries])
        radius = np.array([far[queries][cell[queries] == c].max() for c in own])
        cells = np.unique(cell)
        small = [np.sort(far[cell == c])[:11] for c in cells]
        least = n.reach(p, own, radius, np.full(len(own), float(n.LOW)), cells, small, 10)
        dots = x @ x.T
        for q in queries:
            a = np.flatnonzero(own == cell[q])[0]
            need = np.argsort(-dots[q])[:11]
            assert all(far[r] >= least[a, np.flatnonzero(cells == cell[r])[0]] for r in need if dots[q, r] > np.sort(dots[q])[-12])
        left_out += sum((far[cell == c] < least[a, b]).sum() for a in range(len(own)) for b, c in enumerate(cells))
    assert left_out > 1000
