"""Exact top-k by inner product as a Voronoi join.

Pivots from a bounded sample cut the space into cells. Queries and data go to the cell of their nearest
pivot; a summary of each cell has its size, its largest residual (distance to the pivot) and its smallest
ones. From summaries alone follow, for a cell of queries, a score that its k-th best answer reaches at
least, and for each cell of data the residual from which one of its rows may reach that score. Only data
from there on meet the cell's queries, in tiles; within two tiles the same bound is used query by query.

Small cells of queries are put together, so data aren't sent for a few queries; large ones are split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import bounded, written
from llm.embeddings import _tiles

K = 10
SCALE = 1024  # components are floor(SCALE * x)
PIVOTS = 128  # of each vector length
SAMPLE = 2048  # vectors from which pivots are made; also the first answers of each query
QUERIES = 2048  # of a tile
TILE = 8192  # rows of a tile of data
STEP = 1024  # rows of a tile that are scored at once
LOW, HIGH = -(1 << 63), (1 << 63) - 1  # scores beyond are these
EXACT = float(1 << 52)  # products of norms below are exact in doubles
SLACK = 1e-6


def integers(x: np.ndarray) -> np.ndarray:
    """Integer components, as doubles, which hold them exactly; beyond their range, the nearest."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x.astype(np.float64)), -np.finfo(float).max, np.finfo(float).max)


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(axis=1))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors as longs; those that don't fit are the least or greatest long."""
    largest = norms(q).max(initial=0.0) * norms(x).max(initial=0.0)
    if largest < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in q], [[int(v) for v in row] for row in x]
    return np.array([[min(max(sum(a * b for a, b in zip(r, s)), LOW), HIGH) for s in whole[1]] for r in whole[0]], np.int64).reshape(len(q), len(x))


def pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = 5) -> np.ndarray:
    """At most ``n`` cell centres, by a few rounds of k-means; any pivots give the same answers."""
    p = sample[:n].copy()
    for _ in range(rounds if np.isfinite(norms(sample)).all() else 0):
        cell = nearest(sample, p)[0]
        for c in np.unique(cell):
            p[c] = sample[cell == c].mean(axis=0)
    return p


def nearest(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance to it."""
    with np.errstate(all="ignore"):
        cell = np.argmin((p * p).sum(axis=1) - 2 * x @ p.T, axis=1)
        return cell, np.nan_to_num(norms(x - p[cell]), nan=np.inf)


def wanted(known: np.ndarray) -> np.ndarray:
    """Known scores as bounds on true inner products: what isn't above LOW asks nothing, none asks more than HIGH."""
    return np.where(known > LOW, np.minimum(known, float(HIGH)), -np.inf)


def reach(p: np.ndarray, own: np.ndarray, radius: np.ndarray, known: np.ndarray, cells: np.ndarray, small: list[np.ndarray], k: int) -> np.ndarray:
    """For cells ``own`` of queries and ``cells`` of data: residuals from which data may be an answer.

    ``radius`` are the largest residuals of queries, ``known`` scores that all queries of a cell surely reach,
    ``small`` the k + 1 smallest residuals of each data cell: query q = p + u and row x = r + v have at least
    the score pr - |p||v| - |u||r| - |u||v|, and at most the same with plus signs.
    """
    with np.errstate(all="ignore"):
        a, b = p[own], p[cells]
        middle, far_a, far_b = a @ b.T, norms(a), norms(b)
        spread = radius[:, None] * far_b[None, :]
        width = (far_a + radius)[:, None]
        sure = np.concatenate([middle[:, [j]] - spread[:, [j]] - width * v[None, :] for j, v in enumerate(small)], axis=1)
        sure = np.where(np.isnan(sure), -np.inf, sure)
        if sure.shape[1] > k:
            known = np.maximum(known, np.partition(sure, sure.shape[1] - k - 1, axis=1)[:, sure.shape[1] - k - 1])
        known = wanted(known)
        slack = SLACK * (1 + np.abs(middle) + spread + np.abs(np.maximum(known, LOW))[:, None])
        least = (known[:, None] - slack - middle - spread) / np.maximum(width, 1e-300)
        return np.where(np.isnan(least), -np.inf, least)


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, pivot: np.ndarray, far: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``(query, row, score)``: the k + 1 best rows of each query among those that reach ``known``, ties to smaller ids.

    Rows are scored from the largest residual down; a query is left out of a step once neither the step's
    residual nor its own norm lets a row reach what the query has.
    """
    order = np.lexsort((ids, -far))
    x, ids, far = x[order], ids[order], far[order]
    least, n_q = wanted(known), norms(q)
    with np.errstate(all="ignore"):
        toward = q @ pivot
    found: list[tuple[np.ndarray, ...]] = []
    top = np.full((len(q), k + 1), -np.inf)
    for s in range(0, len(x), STEP):
        part = x[s : s + STEP]
        with np.errstate(all="ignore"):
            can = toward + n_q * far[s]
            can += SLACK * (1 + np.abs(toward) + n_q * far[s])
        go = np.flatnonzero(~(can < least))
        if not len(go):
            continue
        got = scores(q[go], part)
        i, j = np.nonzero(got >= least[go, None])
        found.append((go[i], s + j, got[i, j]))
        with_own = np.concatenate([top[go], got.astype(np.float64)], axis=1)
        top[go] = np.partition(with_own, with_own.shape[1] - k - 1, axis=1)[:, -k - 1 :]
        least[go] = np.maximum(least[go], top[go].min(axis=1) - np.abs(top[go].min(axis=1)) * 1e-9)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, score = (np.concatenate(c) for c in zip(*found))
    by = np.lexsort((ids[j], ~score, i))  # ~ turns the order of longs round
    i, j, score = i[by], j[by], score[by]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place <= k
    return i[keep], order[j[keep]], score[keep]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d))


def _placed(rows: DataFrame, centres: dict[int, np.ndarray], first: dict[int, np.ndarray] | None, k: int) -> DataFrame:
    """``rows`` with ``dim, cell, far``; with ``first``, sampled vectors, also ``known``, a score that k + 1 of these reach."""

    def run(batches):
        for b in batches:
            sizes = np.array([len(e) for e in b.column("embedding")], np.int64)
            cell, far, known = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.full(b.num_rows, float(LOW))
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = _matrix(b.column("embedding").take(pa.array(at)), d)
                cell[at], far[at] = nearest(x, centres.get(d, np.zeros((1, d))))
                if first is not None and len(first.get(d, ())) > k:
                    s = scores(x, first[d])
                    known[at] = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
            columns = [*b.columns, pa.array(sizes), pa.array(cell), pa.array(far), pa.array(known)]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "dim", "cell", "far", "known"])

    more = [T.StructField(n, t()) for n, t in (("dim", T.LongType), ("cell", T.LongType), ("far", T.DoubleType), ("known", T.DoubleType))]
    return bounded(rows).mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def _packed(rows: DataFrame, by: list[str], lists: list[str]) -> DataFrame:
    """A row for each tile: ``lists`` as arrays and all vectors as one block of bytes."""
    own = np.float32 if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    kind = T.StructType([*(rows.schema[c] for c in by), *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in lists), T.StructField("block", T.BinaryType())])

    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        block = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(own).tobytes()
        columns = [*(first[c] for c in by), *(pa.array([table[c].to_pylist()], pa.list_(table.schema.field(c).type)) for c in lists), pa.array([block], pa.binary())]
        return pa.table(columns, names=kind.names)

    return rows.select(*by, *lists, "embedding").groupBy(*by).applyInArrow(run, kind)


def _smallest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; a rank with a limit, so all but these stay out of the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n).drop("place")


def _reaches(cells: DataFrame, asked: DataFrame, centres: dict[int, np.ndarray], k: int) -> tuple[list, list]:
    """Rows ``(dim, own, cell, least)`` and ``(dim, own, base, parts)`` of the summaries, at most PIVOTS by PIVOTS of a length."""
    data, queries, pairs, tiles, base = {}, {}, [], [], 0
    for r in cells.collect():
        data.setdefault(r.dim, []).append(r)
    for r in asked.collect():
        queries.setdefault(r.dim, []).append(r)
    for d, own in queries.items():
        p, others = centres.get(d, np.zeros((1, d))), data.get(d, [])
        left, at, room = {r.cell: r for r in own}, own[0].cell, 0
        while left:  # cells of queries from neighbour to neighbour, put together up to QUERIES
            r = left.pop(at)
            parts = -(-r.n // QUERIES)
            if parts > 1 or r.n > room:
                base, room = base + (tiles[-1][3] if tiles else 0), 0 if parts > 1 else QUERIES
            room = max(0, room - r.n)
            tiles.append((d, r.cell, base, parts))
            at = min(left, key=lambda c: float(((p[c] - p[at]) ** 2).sum()), default=None)  # noqa: B023
        if others:
            own_at = np.array([r.cell for r in own])
            least = reach(p, own_at, np.array([r.radius for r in own]), np.array([r.known for r in own]), np.array([r.cell for r in others]), [np.array(r.small) for r in others], k)
            pairs += [(d, int(i), int(o.cell), float(least[x, y])) for x, i in enumerate(own_at) for y, o in enumerate(others) if least[x, y] <= o.radius]
    return pairs, tiles


def top_k(vectors: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of greatest score for each row where ``asked`` holds.

    The score is the inner product of the vectors with components floor(1024 * x); ties go to the smaller
    ``vec_id``, null last. A row isn't its own answer, but an equal one is. Null vectors and those with null or
    non-finite components take no part; vectors of different lengths never meet (empty ones score 0 with each
    other); scores that don't fit a long are the nearest long. Of equal vectors only the k + 1 rows of smallest
    id can be answers, so no more are kept as such, and equal queries are answered once. Repeated ids are rows
    of their own; further columns are not carried; an empty table gives an empty result.
    """
    fit = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(fit, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"), "embedding",
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"),
    )
    same = ["h1", "h2"]
    by_id = F.col("vec_id").asc_nulls_last()
    data = written(_smallest(rows.drop("asked"), same, [by_id], k + 1), "data")
    sample: dict[int, list] = {}
    for r in data.orderBy(F.xxhash64("h1", "vec_id"), "h2").select("embedding").limit(SAMPLE).collect():
        sample.setdefault(len(r[0]), []).append(r[0])
    first = {d: integers(np.array(x, float).reshape(len(x), d)) for d, x in sample.items()}
    centres = {d: pivots(x) for d, x in first.items()}

    named = rows.where("asked").select("vec_id", *same)
    questions = rows.where("asked").groupBy(*same).agg(F.first("embedding").alias("embedding"))
    questions = written(_placed(questions, centres, first, k), "questions")
    data = written(_placed(data, centres, None, k), "placed")
    small = _smallest(data, ["dim", "cell"], [F.col("far")], k + 1).groupBy("dim", "cell").agg(F.collect_list("far").alias("small"))
    cells = data.groupBy("dim", "cell").agg(F.max("far").alias("radius")).join(small, ["dim", "cell"])
    asked_cells = questions.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.min("known").alias("known"))
    pairs, groups = _reaches(cells, asked_cells, centres, k)

    spark = vectors.sparkSession
    groups = F.broadcast(spark.createDataFrame(groups, "dim bigint, cell bigint, base bigint, parts bigint"))  # a row for each cell of queries
    reached = F.broadcast(spark.createDataFrame(pairs, "dim bigint, own bigint, cell bigint, least double"))  # for each two cells
    group = F.col("base") + F.pmod(F.xxhash64(*same), F.col("parts"))
    questions = questions.join(groups, ["dim", "cell"]).withColumn("group", group)
    tiles = _tiles(data.withColumnRenamed("cell", "label").withColumnRenamed("far", "lead").withColumn("node", F.xxhash64("vec_id", *same)), TILE)
    tiles = tiles.select("vec_id", *same, "embedding", "dim", F.col("label").alias("cell"), F.col("lead").alias("far"), "tile")
    one = written(_packed(questions, ["dim", "group"], [*same, "known"]), "queries")
    two = written(_packed(tiles, ["dim", "cell", "tile"], ["vec_id", *same, "far"]), "tiles")
    box = two.select("dim", "cell", "tile", F.array_max("far").alias("hi"))
    meet = questions.select("dim", F.col("cell").alias("own"), "group").distinct().join(reached, ["dim", "own"]).groupBy("dim", "group", "cell").agg(F.min("least").alias("least"))
    meet = meet.join(box, ["dim", "cell"]).where("hi >= least").select("dim", "group", "cell", "tile")
    two = two.select("dim", "cell", "tile", "vec_id", F.col("h1").alias("c1"), F.col("h2").alias("c2"), "far", F.col("block").alias("block2"))
    both = meet.join(one, ["dim", "group"]).join(two, ["dim", "cell", "tile"]).drop("tile", "group")
    own = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64

    def solve(batches):
        names = ["h1", "h2", "vec_id", "c1", "c2", "score"]
        for b in batches:
            for r in (b.slice(n, 1) for n in range(b.num_rows)):
                d, cell = r.column("dim")[0].as_py(), r.column("cell")[0].as_py()
                whole = lambda c: r.column(c).flatten()  # noqa: B023, E731
                q, x = (integers(np.frombuffer(r.column(c)[0].as_py(), own).reshape(len(whole(n)), d)) for c, n in (("block", "h1"), ("block2", "c1")))  # noqa: B023
                ids = whole("vec_id").fill_null(HIGH).to_numpy()
                at = best(q, x, ids, centres.get(d, np.zeros((1, d)))[cell], whole("far").to_numpy(), whole("known").to_numpy(), k)
                i, j = pa.array(at[0]), pa.array(at[1])
                yield pa.RecordBatch.from_arrays([whole("h1").take(i), whole("h2").take(i), *(whole(c).take(j) for c in ("vec_id", "c1", "c2")), pa.array(at[2], pa.int64())], names)

    answers = bounded(both).mapInArrow(solve, "h1 bigint, h2 bigint, vec_id bigint, c1 bigint, c2 bigint, score bigint")
    top = _smallest(answers, same, [F.col("score").desc(), by_id], k + 1)
    entry = F.struct((-F.col("score").cast("decimal(20,0)")).alias("order"), F.col("vec_id").isNull().alias("last"), "vec_id", "c1", "c2", "score")
    top = written(top.groupBy(*same).agg(F.array_sort(F.collect_list(entry)).alias("top")), "top")
    mine = lambda x: x["vec_id"].eqNullSafe(F.col("query_id")) & (x["c1"] == F.col("h1")) & (x["c2"] == F.col("h2"))
    out = named.withColumnRenamed("vec_id", "query_id").join(top, same).withColumn("own", F.array_position(F.transform("top", mine), True))
    kept = F.filter("top", lambda x, i: (F.col("own") == 0) | (i != F.col("own") - 1))
    out = out.select("query_id", F.posexplode(F.slice(kept, 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
