"""Line deduplication by winnowing over line hashes.

A window is the shortest run of lines, from a line forward or back, of WORDS words; each selects its line
of least hash. Two places that share a run of WORDS words share such a window, hence a selected line at
the same place of it, so only selected lines are positions to compare. Positions of a line that is
selected twice are joined with the first position whose window agrees, both being matched further out,
line by line, as far as their windows reach. Runs of later positions go. As every line of a shared run
lies in a forward or backward window inside it, no line of a run is missed when its first position
differs further out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded, ddl, written

WORDS = 50
_ODD = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers have inverses


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def windows(text: str, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """``start, end, place, hash`` of all windows, ``end`` exclusive, and the lines' hashes.

    The hash of a window is made of other halves of the lines' digests than those that select a line.
    """
    lines = [line.strip() for line in text.split("\n")]
    n = len(lines)
    digest = np.array([list(divmod(xxhash.xxh128_intdigest(x.encode("utf-8", "replace")), 2**64)) for x in lines], np.uint64)
    cum = np.r_[0, np.cumsum([len(x.split()) for x in lines])]
    forward = np.searchsorted(cum, cum[:-1] + words)
    back = np.searchsorted(cum, cum[1:] - words, side="right") - 1
    some, ends = np.flatnonzero(forward <= n), np.flatnonzero(back >= 0) + 1
    start, end = np.r_[some, back[ends - 1]], np.r_[forward[some], ends]
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    start, end = np.unique(np.stack([start, end], 1), axis=0).T
    low = digest[:, 1]
    place = _least(low, start, end)
    power, inverse = _powers(n, _ODD), _powers(n, np.uint64(pow(int(_ODD), -1, 2**64)))
    prefix = np.r_[np.uint64(0), np.cumsum(digest[:, 0] * power[:n], dtype=np.uint64)]
    whole = (prefix[end] - prefix[start]) * inverse[start] + power[end - start]
    return start, end, place, whole.view(np.int64), low.view(np.int64)


def _least(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the least value in each ``[start, end)``, the last of equals, by a sparse table."""
    table, step = [np.arange(len(x))], 1
    while 2 * step <= int((end - start).max()):
        a, b = table[-1][:-step], table[-1][step:]
        table.append(np.where(x[b] <= x[a], b, a))
        step *= 2
    level = np.frexp((end - start).astype(float))[1] - 1
    out = np.empty(len(start), np.int64)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        a, b = table[k][start[at]], table[k][end[at] - (1 << k)]
        out[at] = np.where(x[b] <= x[a], b, a)
    return out


_KIND = "place int, fp bigint, lo int, around array<bigint>, windows array<bigint>"


def _selected(text: str | None, words: int) -> list[np.ndarray]:
    """Of each selected line: its place, hash, the reach ``[lo, hi)`` of the windows that select it, and their number.

    The windows' hashes follow, in the order of the lines that select them, then those of the lines in reach.
    """
    start, end, place, whole, digest = windows(text, words) if text else (np.zeros(0, np.int64),) * 5
    order = np.argsort(place, kind="stable")
    start, end, place, whole = (x[order] for x in (start, end, place, whole))
    at, first, n = np.unique(place, return_index=True, return_counts=True)
    lo, hi = (np.minimum.reduceat(start, first), np.maximum.reduceat(end, first)) if len(at) else (at, at)
    near = np.concatenate([*(digest[i:j] for i, j in zip(lo.tolist(), hi.tolist())), digest[:0]])
    return [at, digest[at], lo, hi, n, whole, near]


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


def _positions(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, key`` and the columns of ``_KIND``: a row for each selected line of each document."""
    names = ["doc_id", "key", "place", "fp", "lo", "around", "windows"]

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 500):
                x = b.slice(s, 500)
                found = [_selected(t, words) for t in x.column("text").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                at, fp, lo, hi, n, whole, near = (np.concatenate([f[k] for f in found]) for k in range(7))
                columns = [pa.array(at, pa.int32()), pa.array(fp), pa.array(lo, pa.int32()), _lists(hi - lo, pa.array(near)), _lists(n, pa.array(whole))]
                yield pa.RecordBatch.from_arrays([x.column("doc_id").take(row), x.column("key").take(row), *columns], names)

    return bounded(docs).mapInArrow(run, f"doc_id {ddl(docs, 'doc_id')}, key bigint, {_KIND}")


def _extended(pairs: DataFrame) -> DataFrame:
    """``doc_id, key, start, end``: the lines around each later position that agree with those around the first one."""

    def run(batches):
        for b in batches:
            place, lo, first_place, first_lo = (b.column(c).to_numpy() for c in ("place", "lo", "first_place", "first_lo"))
            sides = [(c.flatten().to_numpy(), np.r_[0, np.cumsum(c.value_lengths().to_numpy())]) for c in (b.column("around"), b.column("first_around"))]
            out = np.zeros((b.num_rows, 2), np.int32)
            for i in range(b.num_rows):
                x, y = (v[o[i] : o[i + 1]] for v, o in sides)
                p, q = place[i] - lo[i], first_place[i] - first_lo[i]
                n, back = min(len(x) - p, len(y) - q), min(p, q)
                ahead = np.flatnonzero(x[p : p + n] != y[q : q + n])
                behind = np.flatnonzero(x[p - back : p] != y[q - back : q])
                out[i] = place[i] - (back - 1 - behind[-1] if len(behind) else back), place[i] + (ahead[0] if len(ahead) else n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(out[:, 0]), pa.array(out[:, 1])], ["doc_id", "key", "start", "end"])

    return pairs.mapInArrow(run, f"doc_id {ddl(pairs, 'doc_id')}, key bigint, start int, `end` int")


def later_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, key, runs``: ranges of lines of each document that repeat an earlier run.

    Earlier is by (doc_id, key, line), null ids first; ``key`` hashes id and text. No pairs are made: a
    position is compared with one first position for each window that selects it. Frequent windows are
    hot keys of joins of narrow rows, which adaptive execution may split.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    places = written(_positions(keyed, words), "positions")
    here, mark = F.struct("doc_id", "key", "place"), F.xxhash64("doc_id", "key", "place")
    several = F.min(mark) < F.max(mark)  # positions, however many rows repeat a document
    twice = places.groupBy("fp").agg(several.alias("twice")).where("twice").select("fp")
    twice = written(twice, "twice")  # a table of its own, so that adaptive execution can split a frequent line's rows
    match = written(places.join(twice, "fp", "left_semi").dropDuplicates(["doc_id", "key", "place"]), "matches")
    seeds = match.select("doc_id", "key", "place", "fp", F.explode("windows").alias("whole"))
    first = seeds.groupBy("fp", "whole").agg(F.min(here).alias("first"), several.alias("twice")).where("twice").drop("twice")
    first = written(first, "first")
    again = seeds.join(first, ["fp", "whole"]).where(~here.eqNullSafe(F.col("first")))
    again = again.select("doc_id", "key", "place", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "key", "place"))).distinct()
    near = match.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("place").alias("p"), "lo", "around")
    for side in ("", "first_"):
        at = F.col(f"{side}doc_id").eqNullSafe(F.col("d")) & (F.col(f"{side}key") == F.col("k")) & (F.col(f"{side}place") == F.col("p"))
        again = again.join(near.withColumnsRenamed({"lo": f"{side}lo", "around": f"{side}around"}), at).drop("d", "k", "p")
    return _extended(again).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("runs"))


def _cut(text: str, runs: list[dict]) -> tuple[str, int]:
    lines = text.split("\n")
    edge = np.zeros(len(lines) + 1, np.int64)
    for r in runs:
        edge[r["start"]] += 1
        edge[r["end"]] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return "\n".join(x for x, g in zip(lines, gone) if not g), int(gone.sum())


def deduplicated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: ``doc_id, text`` without later repeated runs, ``n_lines``, ``n_cut``.

    A line goes if it lies in a run of consecutive lines with ``words`` words or more, equal but for
    space at their ends, that also stands earlier: in a document of smaller id, or higher up in the
    same one. Null texts stay null with no lines; empty texts have one line. Rows that repeat both id
    and text count as one document and all keep the same lines. Further columns are not carried.
    """
    runs = later_runs(docs, words).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "runs")
    kind = f"doc_id {ddl(docs, 'doc_id')}, text string, n_lines bigint, n_cut bigint"
    rows = docs.select("doc_id", "text").withColumn("__hash", F.xxhash64("doc_id", "text"))
    rows = rows.join(runs, rows["doc_id"].eqNullSafe(runs["__id"]) & (rows["__hash"] == runs["__key"]), "left").select("doc_id", "text", "runs")

    def run(batches):
        for b in batches:
            texts, found = b.column("text").to_pylist(), b.column("runs").to_pylist()
            got = [(t, 0) if t is None or not r else _cut(t, r) for t, r in zip(texts, found)]
            lines = pa.array([0 if t is None else t.count("\n") + 1 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), lines, pa.array([g[1] for g in got], pa.int64())],
                ["doc_id", "text", "n_lines", "n_cut"],
            )

    return bounded(rows).mapInArrow(run, kind)
