"""Alignment of two tokenizers by a dangling-suffix transducer.

Tokens of both sides are read in turn. The state is which side leads and the bytes that the other hasn't
matched yet; the side behind reads next, and where nothing dangles both ends meet and a group closes.
Transitions are kept by state and next token, so bytes are compared once for each pair of these.

Tokens of a group are linked, all with all. How many documents hold a pair of ids linked is summed over
the corpus: tasks count a batch of documents, one row for each batch goes on, and each batch asks for
the counts of its distinct pairs only, so a pair that all documents hold comes once per batch.
"""

from __future__ import annotations

import hashlib
import json
from itertools import count
from operator import itemgetter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm.common import bounded, ddl, written

MEMO = 2_000_000  # transitions that a worker keeps
GROUP = 32 << 20  # bytes of a row group of batches, which are written and read a row group at a time
SLICE = 1 << 20  # bytes of texts whose tokens a worker holds at once
WIDE = 4096  # links of a group from which equal ids are counted before they are paired
LONG_RUN = 4096  # characters; pieces that may be longer are left to the tokenizer library
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: how the byte-level vocabulary splits text


END = -1  # in place of a token, after the last one


class Dangling(dict):
    """A state of the transducer: the side that leads and its bytes without a match.

    Maps the next token to a state, or to None where the token's bytes don't match. Where nothing dangles the
    second side counts as the leading one, so the first reads.
    """

    __slots__ = ("pair", "lead", "rest")

    def __init__(self, pair: Pair, lead: int, rest: bytes):
        self.pair, self.lead, self.rest = pair, lead, rest

    def __missing__(self, token: int) -> Dangling | None:
        pair, rest = self.pair, self.rest
        own = pair.tokens[1 - self.lead][token] if token != END else b""
        if not own or not (own.startswith(rest) or rest.startswith(own)):
            new = None
        elif len(own) > len(rest):
            new = pair.state(1 - self.lead, own[len(rest) :])
        else:
            new = pair.state(self.lead, rest[len(own) :])
        pair.known += 1
        self[token] = new
        return new


class Pair:
    """Two vocabularies as lists of bytes, and the transducer between them."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.tokens = (first, second)
        self._forget()

    def _forget(self) -> None:
        self.known, self._states = 0, {}
        self.start = Dangling(self, 1, b"")

    def state(self, lead: int, rest: bytes) -> Dangling:
        if not rest:
            return self.start
        if (s := self._states.get((lead, rest))) is None:
            s = self._states[lead, rest] = Dangling(self, lead, rest)
        return s

    def ends(self, first: list[int], second: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of either side are read where groups close; None if the sides don't spell the same."""
        if self.known > MEMO:
            self._forget()
        start, i, j, m, n = self.start, 0, 0, len(first), len(second)
        first, second = [*first, END], [*second, END]
        at_first, at_second = [], []
        while i < m:
            s = start[first[i]][second[j]]
            i, j = i + 1, j + 1
            while s is not start:
                if s is None:
                    return None
                if s.lead:  # the first side is behind
                    s = s[first[i]]
                    i += 1
                else:
                    s = s[second[j]]
                    j += 1
            at_first.append(i)
            at_second.append(j)
        return (at_first, at_second) if j == n else None


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies are written."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = count(256)
    return {chr(b if b in shown else next(rest)): b for b in range(256)}


class Aligner:
    """Both tokenizers of two files: a byte-level BPE of the tokenizers library and a SentencePiece model."""

    def __init__(self, first: str, second: str):
        with open(first, encoding="utf-8") as f:
            data = json.load(f)
        byte, vocabulary = byte_alphabet(), data["model"]["vocab"]
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            tokens[k] = bytes(byte[c] for c in piece) if set(piece) <= byte.keys() else piece.encode()
        self._file, self._library = first, None
        special = {x["id"] for x in data["added_tokens"]}
        merges = [m if isinstance(m, str) else " ".join(m) for m in data["model"]["merges"]]
        ordered = all(vocabulary.get(m.replace(" ", "")) == 256 + k for k, m in enumerate(merges))
        # ids in the order of merges are ranks; then the faster encoder gives the same ids
        ranks = {t: k for k, t in enumerate(tokens) if k not in special}
        self._fast = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None
        self._second = SentencePieceProcessor(model_file=second)
        pieces = [self._second.id_to_piece(i) for i in range(self._second.get_piece_size())]
        pieces = [bytes([int(p[3:-1], 16)]) if self._second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.pair = Pair(tokens, pieces)
        some = range(max(len(tokens), len(pieces)))
        self.inside, self.bar, self.end = (np.array([b"%d" % i + mark for i in some], object) for mark in (b",", b"|", b";"))

    def first(self, text: str) -> list[int]:
        if self._fast and max(map(len, text.split(" "))) < LONG_RUN and " " * LONG_RUN not in text:
            return self._fast.encode_ordinary(text)
        if not self._library:
            self._library = Tokenizer.from_file(self._file)
            self._library.encode_special_tokens = True
        return self._library.encode(text, add_special_tokens=False).ids

    def groups(self, texts: list[str | None]) -> Groups:
        """The groups of each text; a text that the tokens don't spell has no tokens."""
        some = [t or "" for t in texts]
        second = self._second.encode(some, num_threads=1)
        out = []
        for text, b in zip(some, second):
            a = self.first(" " + text) if text else []
            spelt = a and b"".join(itemgetter(*a)(self.pair.tokens[0]) if len(a) > 1 else (self.pair.tokens[0][a[0]],)) == (" " + text).encode("utf-8", "replace")
            ends = self.pair.ends(a, b) if spelt else None
            out.append(tuple(np.array(x, np.int32) for x in ((a, b, *ends) if ends else ([], [], [], []))))
        return Groups(self, out)


class Groups:
    """Token ids and groups of some texts, as flat arrays."""

    def __init__(self, own: Aligner, texts: list[tuple]):
        self.own = own
        flat = lambda k: np.concatenate([t[k] for t in texts] or [np.zeros(0, np.int32)]).astype(np.int64)
        self.a, self.b = flat(0), flat(1)
        self.n_a, self.n_b, self.n_groups = (np.array([len(t[k]) for t in texts], np.int64) for k in (0, 1, 2))
        self.text = np.repeat(np.arange(len(texts)), self.n_groups)  # of each group
        before = lambda n: (np.cumsum(n) - n)[self.text]
        self.end_a, self.end_b = flat(2) + before(self.n_a), flat(3) + before(self.n_b)
        self.start_a, self.start_b = (np.r_[0, e[:-1]] if len(e) else e for e in (self.end_a, self.end_b))
        self.size_a, self.size_b = self.end_a - self.start_a, self.end_b - self.start_b

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text, the pair (first id times 2**32 plus second id) and the number of links, not yet summed."""
        n = self.size_a * self.size_b
        small = np.flatnonzero(n < WIDE)
        k = n[small]
        group = np.repeat(small, k)
        place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        wide = self.size_b[group]
        parts = [(self.text[group], self.a[self.start_a[group] + place // wide] << 32 | self.b[self.start_b[group] + place % wide], np.ones(len(group), np.int64))]
        for g in np.flatnonzero(n >= WIDE).tolist():
            (x, p), (y, q) = (np.unique(i[s[g] : e[g]], return_counts=True) for i, s, e in ((self.a, self.start_a, self.end_a), (self.b, self.start_b, self.end_b)))
            parts.append((np.full(len(x) * len(y), self.text[g]), np.add.outer(x << 32, y).ravel(), np.outer(p, q).ravel()))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The links, summed by text and pair."""
        text, pair, n = self.links()
        pairs, place = np.unique(pair, return_inverse=True)
        both, own = np.unique(text * max(1, len(pairs)) + place, return_inverse=True)
        return both // max(1, len(pairs)), pairs[both % max(1, len(pairs))], np.bincount(own, n, len(both)).astype(np.int64)

    def written(self) -> list[bytes]:
        """The groups of each text in the order of the text: ``a1,a2|b1;a3|b2,b3``."""
        line = np.empty(len(self.a) + len(self.b), object)
        group_a, group_b = (np.repeat(np.arange(len(s)), s) for s in (self.size_a, self.size_b))
        at_a, at_b = np.arange(len(self.a)), np.arange(len(self.b))
        own = self.own
        line[at_a + self.start_b[group_a]] = np.where(at_a + 1 == self.end_a[group_a], own.bar[self.a], own.inside[self.a])
        line[at_b + self.end_a[group_b]] = np.where(at_b + 1 == self.end_b[group_b], own.end[self.b], own.inside[self.b])
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(line[s:e].tolist())[:-1] for s, e in zip([0, *ends], ends)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """The pair of tokenizers of two files, once per worker."""
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def groups(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``doc_id, groups``: each document's groups as text, empty without tokens; nothing is shuffled."""

    def run(batches):
        for b in batches:
            lines = aligner(first, second).groups(b.column("text").to_pylist()).written()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.decode() for x in lines], pa.string())], ["doc_id", "groups"])

    return bounded(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {ddl(docs, 'doc_id')}, groups string")


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes."""
    ends = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts]) // SLICE
    cuts = np.flatnonzero(ends[1:] != ends[:-1]) + 1 if len(ends) else []
    return [(int(lo), int(hi)) for lo, hi in zip([0, *cuts], [*cuts, len(texts)])] if len(texts) else []


#: A row is a batch of documents, so a writer that looks at its size after 100 rows only would hold all batches of a task, and a reader as well.
LARGE_ROWS = {"parquet.block.size": str(GROUP), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def _batches(docs: DataFrame, first: str, second: str) -> DataFrame:
    """A row for each batch of documents: what is known of each, its distinct pairs, and in how many documents these are."""
    arrays = "".join(f", {c} array<bigint>" for c in (*_COUNTS, "pairs", "n"))
    kind = f"batch bigint, doc_id array<{ddl(docs, 'doc_id')}>{arrays}, sha256 array<string>, of binary, place binary, times binary"

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, b in enumerate(x for x in batches if x.num_rows):
            known, links, sha = [], [], []
            for lo, hi in slices(b.column("text")):
                g = aligner(first, second).groups(b.column("text").slice(lo, hi - lo).to_pylist())
                known.append((g.n_a, g.n_b, g.n_groups))
                text, pair, n = g.distinct()
                links.append((text + lo, pair, n))
                sha += [hashlib.sha256(x).hexdigest() if x else "" for x in g.written()]
            of, pair, times = (np.concatenate(x) for x in zip(*links))
            pairs, place = np.unique(pair, return_inverse=True)
            counts = [*(np.concatenate(x) for x in zip(*known)), np.bincount(of, times, b.num_rows).astype(np.int64), pairs, np.bincount(place, minlength=len(pairs))]
            packed = [of.astype("<u4"), place.astype("<u4"), times.astype("<u8")]
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [pa.array([part << 33 | k]), one(b.column("doc_id")), *(one(pa.array(x)) for x in counts), one(pa.array(sha, pa.string()))]
            names = ["batch", "doc_id", *_COUNTS, "pairs", "n", "sha256", "of", "place", "times"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names)

    return written(bounded(docs.select("doc_id", "text")).mapInArrow(run, kind), "batches", LARGE_ROWS)


def _pair_counts(batches: DataFrame) -> DataFrame:
    """``pair, count, best``: in how many documents a pair of ids is linked, and whether no pair of its first id has more."""
    one = batches.select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.n").alias("n"))
    pairs = written(one.groupBy("pair").agg(F.sum("n").alias("count")), "pairs").withColumn("a", F.shiftright("pair", 32))
    most = written(pairs.groupBy("a").agg(F.max("count").alias("most")), "most")
    return pairs.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``a, b, count, best`` of all pairs of ids that documents hold linked."""
    pairs = _pair_counts(_batches(docs, first, second))
    return pairs.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "count", "best")


def _told(rows: DataFrame) -> DataFrame:
    """``rows(batch, i, count, best)`` as one row for each batch: the counts, and which are best, by ``i``, as bytes.

    Spark sorts the rows, so a task holds those of one batch only, not those of all its batches.
    """

    def run(batches):
        now, parts = None, []

        def packed():
            counts, best = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([counts.astype("<i8").tobytes()], pa.binary()), pa.array([best.astype("u1").tobytes()], pa.binary())], ["batch", "counts", "bests"])

        for b in batches:
            batch, count, best = (b.column(c).to_numpy(zero_copy_only=False) for c in ("batch", "count", "best"))
            cuts = np.flatnonzero(batch[1:] != batch[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                if lo == hi:
                    continue
                if parts and batch[lo] != now:
                    yield packed()
                    parts = []
                now = batch[lo]
                parts.append((count[lo:hi], best[lo:hi]))
        if parts:
            yield packed()

    rows = rows.select("batch", "i", "count", "best").repartition("batch").sortWithinPartitions("batch", "i")
    return rows.mapInArrow(run, "batch bigint, counts binary, bests binary")


def report(docs: DataFrame, first: str, second: str) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` are the links whose pair is in as many documents as any pair of its first id, ``count_sum``
    adds up the documents of each link's pair. Null and empty texts, and texts that either side's tokens
    don't spell, have no tokens: zeros and an empty digest. Repeated rows and null ids are documents of
    their own; further columns are not carried; an empty table gives an empty result.
    """
    batches = _batches(docs, first, second)
    asked = batches.select("batch", F.posexplode("pairs").alias("i", "pair"))
    told = _told(asked.join(_pair_counts(batches), "pair"))
    columns = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    kind = f"doc_id {ddl(docs, 'doc_id')}, {', '.join(f'{c} bigint' for c in columns[1:-1])}, groups_sha256 string"

    def run(rows):
        for b in rows:
            for k in range(b.num_rows):
                r = b.slice(k, 1)
                values = lambda c: r.column(c).flatten()  # noqa: B023, E731
                n = len(values("doc_id"))
                number, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(values("pairs")):
                    number, best = (np.frombuffer(r.column(c)[0].as_py(), k).astype(np.int64) for c, k in (("counts", "<i8"), ("bests", "u1")))
                of, place = (np.frombuffer(r.column(c)[0].as_py(), "<u4").astype(np.int64) for c in ("of", "place"))
                times = np.frombuffer(r.column("times")[0].as_py(), "<u8").astype(np.int64)
                add = lambda x: np.array([int(v) for v in np.bincount(of, x, n)], np.int64) if len(of) else np.zeros(n, np.int64)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [values("doc_id"), *map(values, _COUNTS), pa.array(add(times * best[place])), pa.array(add(times * number[place])), values("sha256")], columns
                )

    rows = batches.drop("n").join(told, "batch", "left")
    return bounded(rows).mapInArrow(run, kind)
