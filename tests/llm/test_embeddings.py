import numpy as np

from llm import embeddings as e
from tests.llm.test_simhash import roots


def plain(rows, threshold=0.93):
    fit = [l is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, l, v, _ in rows]
    unit = [e.unit(np.array([r[2]]))[0] if ok else None for r, ok in zip(rows, fit)]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if fit[a] and fit[b] and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold
    ]
    count = [sum(k in p for p in links) for k in range(len(rows))]
    root = roots(range(len(rows)), links)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(least.get(root[k], r[0]), r[0])
    return sorted(((r[0] is not None, r[0]), n, str(least.get(root[k]))) for k, (r, n) in enumerate(zip(rows, count)))


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(40):
        centre = rng.normal(size=20)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), int(rng.integers(0, 2)), [float(np.float32(x)) for x in centre + rng.normal(size=20) * rng.choice([0, 0.1, 0.3])], "x"))
    n = len(rows)
    rows += [(n, None, [1.0] * 20, "x"), (n + 1, 0, None, "x"), (n + 2, 0, [0.0] * 20, "x"), (n + 3, 0, [float("nan")] * 20, "x"),
             (n + 4, 0, [None] + [1.0] * 19, "x"), (n + 5, 0, [float("inf")] * 20, "x"), (n + 6, 0, [], "x"), (n + 7, 0, [1.0, 2.0], "x"),
             (n + 8, 0, [2.0, 4.0], "x"), (n + 9, 1, [3e38] * 20, "x"), (n + 10, 1, [1e-40] * 20, "x"), (None, 0, [1.0, 2.0], "x"),
             (None, 1, rows[0][2], "x"), (None, 0, rows[0][2], "x"), (None, 1, [-3.0] + [0.0] * 19, "x"), (None, None, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, node string")
    rows = [(i, l, v and [None if x is None else float(np.float32(x)) for x in v], s) for i, l, v, s in rows]
    for tile in (2048, 16):
        got = e.near_duplicates(df, tile=tile).collect()
        assert sorted(((r.vec_id is not None, r.vec_id), r.n_links, str(r.component_id)) for r in got) == plain(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_stopping_early_loses_nothing():
    rng = np.random.default_rng(1)
    x = e.unit(np.repeat(rng.normal(size=(60, 40)), 20, axis=0) + rng.normal(size=(1200, 40)) * 0.25)
    turned = x @ e.principal_basis(x)
    i, j = e.linked(turned, turned, same=True)
    dots = x @ x.T
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(dots >= 0.93)) if a < b}


def test_empty(spark):
    assert e.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).collect() == []


def test_repeated_ids_and_rows(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [1.0, 0.1]), (2, 0, [1.0, 0.1]), (7, 1, [1.0, 0.0])]
    got = e.near_duplicates(spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, label int, embedding array<double>, node long, h1 long")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (7, 0, 7)]


def test_equal_leads_split(spark):
    rng = np.random.default_rng(5)
    leads = spark.createDataFrame([(0, i, 8, 0.5) for i in range(1000)] + [(0, 1000 + i, 8, float(rng.random())) for i in range(1000)], "label int, node long, dim long, lead double")
    sizes = [r["count"] for r in e._tiles(leads, 100).groupBy("label", "dim", "tile").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 200


def test_null_ids_link(spark):
    rows = [(None, 0, [1.0, 0.0]), (2, 0, [1.0, 0.01]), (None, 1, [1.0, 0.0]), (None, 1, [1.0, 0.0])]
    got = e.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == [(2, 1, 2, True), (None, 1, 2, False), (None, 1, None, True), (None, 1, None, True)]


def test_far_tiles_never_meet(spark):
    rng = np.random.default_rng(2)
    turn = rng.random(800) * 2 * np.pi
    centres = np.c_[np.cos(turn), np.sin(turn), np.zeros((800, 14))]
    rows = [(i, 0, (c + rng.normal(size=16) * 0.02).tolist()) for i, c in enumerate(centres)]
    met, every = e.compared_share(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), tile=25)
    assert every > 300 and met < every / 2
