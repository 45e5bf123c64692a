"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned into a principal basis, so that leading dimensions say most. Rows of one label
are cut into tiles along the first of them; tiles whose boxes over the leading dimensions are too far
apart never meet. Tiles next to each other go to a task together, so each is sent to as many tasks as
there are such blocks of tiles, not as there are tiles. Within a pair of tiles,
products are summed dimension block by dimension block; what the rest can add is at most the product
of the suffix norms, and a pair stops as soon as that can't reach the threshold. A tile is one row of
packed floats; the turned vectors are made where two tiles meet and are never stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import bounded, written
from llm.components import connected_components, forest

THRESHOLD = 0.93
SAMPLE = 4096  # vectors from which the basis is fitted; any orthogonal basis gives the same links
TILE = 2048
BLOCK = 4  # tiles of a label that go to tasks together
BOX = 8  # leading dimensions by which tiles are told apart
CUTS = 255  # cut points along the first component for a label; bins over a tile also deal by hash
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", unit(x), unit(y))


def principal_basis(sample: np.ndarray) -> np.ndarray:
    """Orthogonal columns, of falling variance."""
    x = unit(sample)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def linked(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose product may reach the threshold less SLACK, summed block by block.

    ``a`` and ``b`` hold unit vectors in the principal basis; ``same`` keeps only pairs i < j.
    """
    d, found_i, found_j = a.shape[1], [], []
    stops = [s for s in (8, 16, 32, 64, 128, 256, 512, 1024) if s < d] + [d]
    rest = lambda x: [np.linalg.norm(x[:, s:], axis=1) for s in stops]
    rest_a, rest_b = rest(a), rest(b)
    for r in range(0, len(a), 512):
        for c in range(r if same else 0, len(b), 512):
            x, y = a[r : r + 512], b[c : c + 512]
            dots, at = x[:, : stops[0]] @ y[:, : stops[0]].T, 0
            while True:
                can = dots + np.outer(rest_a[at][r : r + 512], rest_b[at][c : c + 512]) >= threshold - SLACK
                if at + 1 == len(stops) or can.mean() < 0.1:
                    break
                dots += x[:, stops[at] : stops[at + 1]] @ y[:, stops[at] : stops[at + 1]].T
                at += 1
            i, j = np.nonzero(can)
            if same and r == c:
                i, j = i[i < j], j[i < j]
            got = dots[i, j]
            while at + 1 < len(stops) and len(i):
                s, e = stops[at], stops[at + 1]
                at += 1
                got = got + np.einsum("ij,ij->i", x[i, s:e], y[j, s:e])
                go = got + rest_a[at][r + i] * rest_b[at][c + j] >= threshold - SLACK
                i, j, got = i[go], j[go], got[go]
            found_i.append(i + r)
            found_j.append(j + c)
    return np.concatenate(found_i), np.concatenate(found_j)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _turned(x: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    u = unit(x)
    return u @ basis[x.shape[1]] if x.shape[1] in basis else u


def _leads(classes: DataFrame, basis: dict[int, np.ndarray]) -> DataFrame:
    """``classes`` with ``dim`` and ``lead``, the first coordinate in the principal basis."""

    def run(batches):
        for b in batches:
            sizes = np.array([len(e) for e in b.column("embedding")], np.int64)
            lead = np.zeros(b.num_rows)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                lead[at] = _turned(_matrix(b.column("embedding").take(pa.array(at)), len(at)), basis)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), pa.array(lead)], [*b.schema.names, "dim", "lead"])

    more = [T.StructField("dim", T.LongType()), T.StructField("lead", T.DoubleType())]
    return bounded(classes).mapInArrow(run, T.StructType([*classes.schema.fields, *more]))


def _tiles(leads: DataFrame, tile: int) -> DataFrame:
    """``leads`` with ``tile``: bins along the lead, each dealt by hash by its own count, so equal leads split too."""
    probs = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    stats = leads.groupBy("label", "dim").agg(F.count("*").alias("size"), F.percentile_approx("lead", probs, 2000).alias("cuts"))
    stats = written(stats, "stats")
    bins = F.least(F.ceil(F.col("size") / tile), F.lit(CUTS + 1))
    fine = F.size(F.filter("cuts", lambda c: c < F.col("lead")))
    binned = leads.join(stats, ["label", "dim"]).withColumn("bin", F.floor(fine * bins / (CUTS + 1))).drop("cuts", "size")
    counts = written(binned.groupBy("label", "dim", "bin").agg(F.ceil(F.count("*") / tile).alias("parts")), "bins")
    part = F.pmod(F.xxhash64("node"), "parts")
    return binned.join(counts, ["label", "dim", "bin"]).select(*leads.columns, F.struct("bin", part.alias("part")).alias("tile"))


def apart(lo, hi, lo2, hi2) -> float:
    """The squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(np.subtract(lo2, hi), np.subtract(lo, hi2)))
    return float((gap * gap).sum())


def _packed(tiles: DataFrame, basis: dict[int, np.ndarray], exact) -> DataFrame:
    """``label, dim, tile, lo, hi, nodes, counts, block``: a row per tile with its box and its floats as bytes."""
    kind = T.StructType([
        *(tiles.schema[c] for c in ("label", "dim", "tile")), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("lo", "hi")),
        T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("block", T.BinaryType()),
    ])

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table["embedding"].combine_chunks(), table.num_rows).astype(exact)
        lead = _turned(x, basis)[:, :BOX]
        more = *([e.tolist()] for e in (lead.min(axis=0), lead.max(axis=0))), [table["node"].to_pylist()], [table["n"].to_pylist()], pa.array([x.tobytes()], pa.binary())
        first = table.slice(0, 1)
        return pa.table([*(first[c] for c in ("label", "dim", "tile")), *more], names=kind.names)

    columns = ("label", "dim", "tile", "lead", "node", "n", "embedding")
    return tiles.select(*columns).groupBy("label", "dim", "tile").applyInArrow(run, kind)


def _compare(packed: DataFrame, meet: DataFrame, basis: dict[int, np.ndarray], threshold: float, exact) -> DataFrame:
    """``node, links, other``: for each pair of blocks of tiles how many rows each node links to, and edges that connect them.

    ``meet(label, dim, a, b)`` names the pairs of blocks; a task holds the tiles of two.
    """
    far = 2 - 2 * threshold + SLACK

    def solve(rows: list[dict]) -> tuple[np.ndarray, ...]:
        for r in rows:
            r["nodes"], r["counts"] = np.array(r["nodes"]), np.array(r["counts"])
            r["x"] = np.frombuffer(r["block"], exact).reshape(-1, r["dim"])
            r["turned"] = _turned(r["x"], basis)
        out = [np.zeros(0, np.int64)] * 3, [np.zeros(0, np.int64)] * 2
        for r in (r for r in rows if r["at"] == r["a"]):
            for s in (s for s in rows if s["at"] == s["b"] and r["number"] <= s["number"] and apart(r["lo"], r["hi"], s["lo"], s["hi"]) <= far):
                same = r["number"] == s["number"]
                i, j = linked(r["turned"], s["turned"], threshold, same)
                ok = np.zeros(len(i), bool)
                for k in range(0, len(i), 100_000):
                    ok[k : k + 100_000] = cosine(r["x"][i[k : k + 100_000]], s["x"][j[k : k + 100_000]]) >= threshold
                i, j = i[ok], j[ok]
                for own, n in ((r, np.bincount(i, s["counts"][j], len(r["x"]))), (s, np.bincount(j, r["counts"][i], len(s["x"])))):
                    own["links"] = own.get("links", 0) + n
                edges = forest(np.r_[out[1][0], r["nodes"][i]], np.r_[out[1][1], s["nodes"][j]])
                out = out[0], list(edges)
        some = [(r["nodes"][e], r["links"][e].astype(np.int64)) for r in rows if "links" in r for e in [np.flatnonzero(r["links"])]]
        node, links = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in some)]) for k in (0, 1))
        far_end, near_end = out[1]
        return np.r_[node, far_end], np.r_[links, np.zeros(len(far_end), np.int64)], np.r_[node, near_end]

    def run(table: pa.Table) -> pa.Table:
        return pa.table([pa.array(x, pa.int64()) for x in solve(table.to_pylist())], names=["node", "links", "other"])

    at = F.explode(F.array_distinct(F.array("a", "b"))).alias("at")
    rows = meet.select("label", "dim", "a", "b", at).join(packed.withColumnRenamed("own", "at"), ["label", "dim", "at"])
    columns = ["label", "dim", "a", "b", "at", "number", "lo", "hi", "nodes", "counts", "block"]
    return rows.select(*columns).groupBy("label", "dim", "a", "b").applyInArrow(run, "node bigint, links bigint, other bigint")


def _blocks(packed: DataFrame) -> DataFrame:
    """``packed`` with the tile's ``number`` within its label and the block ``own`` that it belongs to; over rows of tiles."""
    number = F.row_number().over(Window.partitionBy("label", "dim").orderBy("tile")) - 1
    numbers = packed.select("label", "dim", "tile", number.alias("number"))
    return packed.join(numbers, ["label", "dim", "tile"]).withColumn("own", F.floor(F.col("number") / BLOCK))


def _meeting(boxes: DataFrame, threshold: float) -> DataFrame:
    """``label, dim, p, q``: pairs of tiles, by number, whose boxes are near enough to hold a link."""
    other = boxes.select("label", "dim", F.col("number").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gap = F.zip_with(
        F.arrays_zip("lo", "hi"), F.arrays_zip("lo2", "hi2"),
        lambda x, y: F.pow(F.greatest(F.lit(0.0), y["lo2"] - x["hi"], x["lo"] - y["hi2"]), F.lit(2.0)),
    )
    near = F.aggregate(gap, F.lit(0.0), lambda x, y: x + y) <= 2 - 2 * threshold + SLACK
    return boxes.withColumnRenamed("number", "p").join(other, ["label", "dim"]).where((F.col("p") <= F.col("q")) & near).select("label", "dim", "p", "q")


def compared_share(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> tuple[int, int]:
    """How many pairs of tiles are compared, and how many there are."""
    packed = _prepared(vectors, tile)[2].select("label", "dim", "number", "lo", "hi")
    n = F.count("*").cast("bigint")
    every = packed.groupBy("label", "dim").agg((n * (n + 1) / 2).cast("bigint").alias("n")).agg(F.sum("n")).first()[0] or 0
    return _meeting(packed, threshold).count(), every


def _prepared(vectors: DataFrame, tile: int):
    """All rows with ``fit`` and their hashes, what names a class of equal ones, tiles of classes, classes, basis and number type."""
    rows = vectors.select("vec_id", "label", "embedding")
    fit = (
        F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    # two hashes from different seeds stand for the vector wherever only equality counts
    rows = rows.select("*", F.coalesce(fit, F.lit(False)).alias("fit"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    fitting = rows.where("fit")
    sample: dict[int, list] = {}
    for r in fitting.orderBy(F.xxhash64("h1", "vec_id"), "h2").select("embedding").limit(SAMPLE).collect():
        sample.setdefault(len(r[0]), []).append(r[0])
    basis = {d: principal_basis(np.array(x)) for d, x in sample.items()}
    exact = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    key = ["label", "h1", "h2"]
    grouped = fitting.groupBy(*key).agg(F.first("embedding").alias("embedding"), F.min("vec_id").cast("bigint").alias("id"), F.count("*").alias("n"))
    classes = written(_leads(grouped.withColumn("node", F.monotonically_increasing_id()), basis), "classes")
    packed = written(_blocks(written(_packed(_tiles(classes, tile), basis, exact), "tiles")), "blocks")
    return rows, key, packed, classes, basis, exact


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Only rows with equal labels are compared, by cosine in double precision. Vectors with a null label,
    null, empty or zero vectors, and those with null or non-finite components link with nothing
    and keep their own id as component. Rows with a null id link like others; they name a component (null)
    only if no other id is in it. Vectors of different lengths never link. Equal vectors of a
    label are compared once, as one class, and counted as often as they occur; different vectors under
    one id are different rows. Further columns are not carried; an empty table gives an empty result.
    Every task holds two blocks of tiles at a time.
    """
    rows, key, packed, classes, basis, exact = _prepared(vectors, tile)
    fitting = rows.where("fit")
    meet = _meeting(packed.select("label", "dim", "number", "lo", "hi"), threshold)
    meet = meet.select("label", "dim", F.floor(F.col("p") / BLOCK).alias("a"), F.floor(F.col("q") / BLOCK).alias("b")).distinct()
    pairs = written(_compare(packed, meet, basis, threshold, exact), "links")

    links = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(pairs.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select(*key, "node", "id", "n").join(links, "node", "left").join(roots, "node", "left")
    named = written(named.select(*key, "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    joined = fitting.select("vec_id", *key).join(named.join(least, "root"), key)
    lone = rows.where("not fit").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    out = joined.select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
