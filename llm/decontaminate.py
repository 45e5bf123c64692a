"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of document words. Test phrases are found by backward search through wavelet ranks,
placed by sampled suffix positions, and the places merge into removal spans. Words that no phrase
holds, and the ends of documents, are separators: no phrase can match over them.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import WORD_TABLE, bounded, fresh, words, written

WINDOW = 10
SHARD_WORDS = 1 << 19
SAMPLE_RATE = 16
PASS_WINDOWS = 500_000  # phrases searched in one pass over the documents; more phrases take more passes


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, where each zero is a separator unlike all others and below all symbols."""
    n = len(text)
    zero = text == 0
    sa = np.empty(n, np.int64)
    zeros = np.flatnonzero(zero)
    sa[: len(zeros)] = zeros
    rank = np.zeros(n + 1, np.int64)  # a rank is the first row of the suffixes that are equal so far
    rank[zeros] = np.arange(1, len(zeros) + 1)
    counts = np.bincount(text)
    first = np.cumsum(counts) - counts + 1
    live = np.flatnonzero(~zero)
    rank[live] = first[text[live]]
    h = 1
    while len(live):
        key = rank[live] * (n + 2) + rank[np.minimum(live + h, n)]
        order = np.argsort(key)
        live, key = live[order], key[order]
        old = rank[live]
        index = np.arange(len(live))
        new_bucket = np.r_[True, old[1:] != old[:-1]]
        new_part = np.r_[True, key[1:] != key[:-1]]
        start = np.maximum.accumulate(np.where(new_bucket, index, 0))
        part = np.maximum.accumulate(np.where(new_part, index, 0))
        rank[live] = old + part - start
        alone = new_part & np.r_[new_part[1:], True]
        sa[rank[live[alone]] - 1] = live[alone]
        live = live[~alone]
        h *= 2
    return sa


class FMIndex:
    """Counts and places phrases in one shard; all methods work on arrays of queries at once."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)  # so that the last suffix, too, follows a character
        n = len(text)
        sa = suffix_order(text)
        before = np.where(sa > 0, text[sa - 1], 0)
        counts = np.bincount(text, minlength=symbols + 1)
        self.n, self.first = n, np.cumsum(counts) - counts
        self.levels, self.bits = [], max(1, int(symbols).bit_length())
        now = before
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, n - int(ones[-1])))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.begin = self._down(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))
        known = (sa % SAMPLE_RATE == 0) | (before == 0)
        self.known = np.zeros(n + 1, np.int32)
        np.cumsum(known, out=self.known[1:])
        self.places = sa[known]

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, ones, zeros in self.levels:
            up = ones[i]
            i = np.where((c >> level) & 1, zeros + up, i - up)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` stands in the first ``i`` characters of the transform."""
        return self._down(c, i) - self.begin[c]

    def _previous(self, row: np.ndarray) -> np.ndarray:
        c, i = np.zeros_like(row), row
        for _, ones, zeros in self.levels:
            up = ones[i]
            bit = ones[i + 1] - up
            c, i = 2 * c + bit, np.where(bit == 1, zeros + up, i - up)
        return self.first[c] + i - self.begin[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[lo, hi)`` of each phrase; phrases are rows of symbols, filled up with zeros in front."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            go = (c > 0) & (lo[live] < hi[live])
            live, c = live[go], c[go]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places in the text, found by walking back to the next sampled suffix."""
        place = np.empty(len(row), np.int64)
        live, steps = np.arange(len(row)), 0
        while len(live):
            at = row[live]
            found = self.known[at + 1] > self.known[at]
            place[live[found]] = self.places[self.known[at[found]]] + steps
            live, steps = live[~found], steps + 1
            row[live] = self._previous(row[live])
        return place


class Phrases:
    """The distinct windows of benchmark items, as symbol rows."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.code: dict[bytes, int] = {}
        table: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.code.setdefault(w, len(self.code) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                table.setdefault(tuple(ids[i : i + window]), set()).add(str(item))
        self.items, self.length = list(table.values()), np.array([len(t) for t in table], np.int64)
        self.width = max(self.length, default=1)
        self.rows = np.array([[0] * (self.width - len(t)) + list(t) for t in table], np.int64).reshape(-1, self.width)

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of all occurrences in a flat run of symbols, shard by shard."""
        found = []
        for a in range(0, len(text), SHARD_WORDS):  # shards overlap, so that none cuts an occurrence
            index = FMIndex(text[a : a + SHARD_WORDS + self.width - 1], len(self.code))
            lo, hi = index.search(self.rows)
            n = hi - lo
            who = np.repeat(np.arange(len(n)), n)
            row = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(who))
            found.append((who, index.locate(row) + a))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text its number of words, merged spans of hit words, and items with a window in it."""
        get, parts, starts, size = self.code.get, [], [0], 0
        for text in texts:
            own = words(text)
            parts.append(np.fromiter(map(get, own, repeat(0)), np.int64, len(own)))
            parts.append(np.zeros(1, np.int64))
            size += len(own) + 1
            starts.append(size)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        who, place = self.hits(flat) if len(self.rows) else (np.zeros(0, np.int64),) * 2
        edge = np.zeros(size + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + self.length[who], -1)
        hit = np.r_[0, (np.cumsum(edge) > 0).astype(np.int8)]
        change = np.flatnonzero(np.diff(hit))
        begin, end = change[::2], change[1::2]
        out = [(b - a - 1, [], []) for a, b in zip(starts, starts[1:])]
        doc = np.searchsorted(starts, begin, side="right") - 1
        for d, b, e in zip(doc.tolist(), begin.tolist(), end.tolist()):
            out[d][1].append((b - starts[d], e - starts[d]))
        if len(place):
            pairs = np.unique(np.stack([np.searchsorted(starts, place, side="right") - 1, who], 1), axis=0)
            sets: dict[int, set[str]] = {}
            for d, p in pairs.tolist():
                sets.setdefault(d, set()).update(self.items[p])
            for d, names in sets.items():
                out[d][2].extend(sorted(names))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns, whose names come with it.

    They are the number of words, the merged word ranges ``[from, to)`` that are hit, and the items found.
    Benchmark items without an id or without words hold no phrase; an item shorter than the window is
    one phrase. Null and empty texts have no words. No shuffle: each task indexes the shards of its
    own documents. The phrases reach the tasks in portions of about PASS_WINDOWS, whose size is checked
    first and of which the driver holds one at a time; further portions are further passes over the
    documents, written and merged row by row. With ``remove`` the last pass cuts the spans out of the texts.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0  # at least as many as windows
    passes = max(1, -(-size // (4 * PASS_WINDOWS)))
    names = fresh(docs.columns, "n_words", "spans", "items")
    kinds = T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())
    out = docs.withColumns({n: F.lit(None).cast(k) for n, k in zip(names, kinds)})
    for k in range(passes):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]
        out = bounded(out).mapInArrow(_pass(part, window, remove and k == passes - 1), out.schema)
        if k < passes - 1:
            out = written(out, "pass")
    return out, names


def _pass(part: list[tuple], window: int, remove: bool):
    def run(batches):
        phrases = Phrases(part, window)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                x = b.slice(at, 2000)
                texts = x.column("text").to_pylist()
                got = phrases.scan(texts)
                spans, names = x.column(x.num_columns - 2).to_pylist(), x.column(x.num_columns - 1).to_pylist()
                got = [
                    (n, merged(s + [tuple(y) for y in before or []]), sorted({*i, *(had or [])}))
                    for (n, s, i), before, had in zip(got, spans, names)
                ]
                columns = [x.column(c) for c in x.schema.names[:-3]]
                if remove:
                    kept = [cut(t, g[1]) if g[1] else t for t, g in zip(texts, got)]
                    columns[x.schema.names.index("text")] = pa.array(kept, x.column("text").type)
                for k, kind in enumerate((pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))):
                    columns.append(pa.array([g[k] for g in got], kind))
                yield pa.RecordBatch.from_arrays(columns, x.schema.names)

    return run


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows and their digest."""
    out, (n, spans, items) = found(docs.select("doc_id", "text"), benchmark, window)
    hit = _covered(spans)
    return out.select(
        "doc_id", F.col(n).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col(spans).alias("spans"),
    )


def _covered(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` and what stands between them."""
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(WORD_TABLE))]
    out, last = [], 0
    for b, e in spans:
        out.append(raw[last : at[b][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8")


def removed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without their removal spans; columns as they came, ``n_chars`` counted anew if there.

    Only documents of which no word is left after a removal go; others without a hit stay untouched.
    """
    out, (n, spans, _) = found(docs, benchmark, window, remove=True)
    hit = F.size(spans) > 0
    out = out.where(~hit | (F.col(n) > _covered(spans)))
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(hit, count).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
