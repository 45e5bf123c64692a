"""Quality by co-training two views.

One classifier sees what a text consists of, the other only the page's metadata (language, source,
length). In rounds each gives its most confident pseudo-labels of unlabelled documents to the other:
those that it finds most unlike the base rate, by a margin, with its own probability as the label, so that a
weak view says no more than it knows. What makes the other view worse on held-out rows is taken back. All unlabelled documents are scored in every round, and the surest of each view and class are found by
a reduction over tasks. Both views are calibrated on one held-out fold, and a last model combines the
calibrated views on another.
"""

from __future__ import annotations

from math import log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import bounded, fresh, written
from llm.labelled import labelled, sample_ids
from llm.linear import Dense, sigmoid

SAMPLE = 3000  # labelled rows of each class, at most
ROUNDS = 3
GIVEN = 200  # the surest documents of a class that a view gives to the other in a round
MARGIN = 0.1  # log odds beyond the base rate from which a view is confident
HARM = 0.005  # rise of the other view's held-out log loss, if beyond its standard error, from which pseudo-labels are taken back
FOLDS = 5  # of the labelled rows: one calibrates, one fits the mix, the others fit the views
OFTEN = 20  # fitting rows from which a language or source has a column of its own; at most SAMPLE / 10 have
PARTS = 16  # groups in which the surest documents of all tasks meet before the last selection


def text_view(text: str | None) -> np.ndarray:
    """Shares of ASCII characters, of upper case, distinct words and lines, word and line lengths."""
    raw = (text or "").encode("utf-8", "replace")
    own = raw.split()
    lines = raw.split(b"\n")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n, w = max(1, len(raw)), max(1, len(own))
    share = np.log1p(1000 * count[:128] / n)
    rest = [
        count[128:].sum() / n, count[65:91].sum() / n, count[48:58].sum() / n, len(set(own)) / w ** 0.9, len(set(lines)) / len(lines),
        log1p(n / w), log1p(n / len(lines)), log1p(max(map(len, own), default=0)), sum(x.isupper() for x in own) / w,
    ]
    return np.r_[share, rest].astype(np.float32)


def text_views(texts: list[str | None]) -> np.ndarray:
    return np.array([text_view(t) for t in texts], np.float32).reshape(len(texts), -1)


class MetaView:
    """Columns for the frequent languages and sources of the fitting rows, and for the length; null is a value."""

    def __init__(self, rows: list[tuple]):
        self.columns = []
        for k in (0, 1):
            values, n = np.unique([repr(r[k]) for r in rows], return_counts=True)
            self.columns.append({v: i for i, v in enumerate(values[n >= OFTEN].tolist())})

    def __call__(self, rows: list[tuple]) -> np.ndarray:
        width = [len(c) for c in self.columns]
        out = np.zeros((len(rows), sum(width) + 3))
        for i, (lang, source, size) in enumerate(rows):
            for column, start, value in zip(self.columns, (0, width[0]), (lang, source)):
                if (at := column.get(repr(value))) is not None:
                    out[i, start + at] = 1
            size = log1p(max(0, size)) if size is not None else None
            out[i, -3:] = (0, 0, 1) if size is None else (size, size * size / 10, 0)
        return out


def _meta(b: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars"))))


class CoTrained:
    """Two views of labelled rows, ``x`` of the text and ``meta``; ``shift`` undoes the sample's balance.

    ``given[k]`` counts the pseudo-labels that view k gave to the other (0 text, 1 metadata), ``refused[k]`` those
    of them that were taken back;
    ``accuracy`` has each calibrated view's and the mix's on the last fold, which fitted only the mix.
    """

    def __init__(self, x: np.ndarray, meta: list[tuple], y: np.ndarray, shift: float = 0.0):
        fold = np.zeros(len(y), np.int64)
        for c in (0, 1):  # every fold has both classes
            fold[y == c] = np.arange((y == c).sum()) % FOLDS
        self.shift, self.given, self.refused = shift, [0, 0], [0, 0]
        self.base = float(shift + np.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum())))
        fit, self._tune, self._last = fold < FOLDS - 2, fold == FOLDS - 2, fold == FOLDS - 1
        self.encode = MetaView([m for m, f in zip(meta, fit) if f])
        self._known = (x, self.encode(meta)), y
        self._own, self._kept = [[(v[fit], y[fit])] for v in self._known[0]], [1, 1]
        self._fit()

    def _fit(self) -> None:
        views, y = self._known
        self.models = [Dense(np.concatenate([a for a, _ in o]), np.concatenate([b for _, b in o])) for o in self._own]
        self.scales = [Dense(m.logits(v[self._tune])[:, None], y[self._tune], 1e-3) for m, v in zip(self.models, views)]
        logits = np.stack([self._view(k, v[self._last]) for k, v in enumerate(views)], 1)
        self.mix = Dense(logits, y[self._last], 1e-3)
        said = [*logits.T, self.mix.logits(logits)]
        self.accuracy = [float(((z + self.shift > 0) == (y[self._last] > 0)).mean()) for z in said]

    def _loss(self, k: int) -> np.ndarray:
        """The log loss of view k on each of the rows that calibrate it."""
        z, y = self._view(k, self._known[0][k][self._tune]), self._known[1][self._tune]
        return np.logaddexp(0, np.where(y > 0, -z, z))

    def learn(self, view: int, target: np.ndarray, x: np.ndarray, meta: list[tuple]) -> None:
        """Pseudo-labels, probabilities of good quality, that ``view`` gives to the other; ``refit`` puts them to use."""
        own = target if not self.shift else sigmoid(np.log(target / (1 - target)) - self.shift)  # on the sample's balance
        self._own[1 - view].append((self.encode(meta) if view == 0 else x, own))

    def refit(self) -> None:
        """Fit with what was learnt since, or without it where it makes a view worse."""
        before, sizes = [self._loss(k) for k in (0, 1)], list(self._kept)
        self._fit()
        for k in (0, 1):
            n = sum(len(t) for _, t in self._own[k][sizes[k] :])
            rise = self._loss(k) - before[k]
            if n and rise.mean() > max(HARM, rise.std() / len(rise) ** 0.5):
                del self._own[k][sizes[k] :]
                self.refused[1 - k] += n
            else:
                self.given[1 - k] += n
        self._fit()
        self._kept = [len(o) for o in self._own]

    def trimmed(self) -> CoTrained:
        """Without the training rows, as tasks need it."""
        out = object.__new__(CoTrained)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("_known", "_own", "_kept", "_tune", "_last")}
        return out

    def _view(self, k: int, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds of one view."""
        return np.clip(self.scales[k].logits(self.models[k].logits(x)[:, None]), -12, 12)

    def views(self, x: np.ndarray, meta: list[tuple]) -> np.ndarray:
        """Log odds of good quality: a row for the text and one for the metadata."""
        return np.stack([self._view(0, x), self._view(1, self.encode(meta))]) + self.shift

    def predict(self, x: np.ndarray, meta: list[tuple]) -> np.ndarray:
        """Columns: combined probability of good quality, that of the text, that of the metadata."""
        a, b = self.views(x, meta) - self.shift
        return sigmoid(np.stack([self.mix.logits(np.stack([a, b], 1)), a, b], 1) + self.shift)


_ROW = "row bigint, x binary, lang string, source string, n_chars bigint"


def _features(docs: DataFrame) -> DataFrame:
    """``doc_id`` (and ``y`` if there), ``row`` (a hash of id and text), ``x`` (text view as floats) and the metadata."""
    first = [c for c in docs.columns if c in ("y", "doc_id")]
    typed = docs.select(
        *first, F.xxhash64("doc_id", "text").alias("row"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("bigint"), "text")

    def run(batches):
        for b in batches:
            x = pa.array([v.tobytes() for v in text_views(b.column("text").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(b.column, first), b.column("row"), x, *map(b.column, ("lang", "source", "n_chars"))], [*first, *_NAMES])

    kind = T.StructType([*(docs.schema[c] for c in first), *T._parse_datatype_string(_ROW).fields])
    return bounded(typed).mapInArrow(run, kind)


_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _surest(pool: DataFrame, model: CoTrained, taken: set[tuple[int, int]]) -> list:
    """Of each view and class the GIVEN surest rows of ``pool`` that the view is confident of and hasn't given yet.

    Every task keeps its own GIVEN, PARTS groups keep theirs of these, and the last selection is of those;
    equal certainty goes by the row's hash, and repeated rows count once.
    """
    slim = model.trimmed()
    kind = f"view int, label int, sure double, part int, {_ROW}"

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sure", "descending"), ("row", "ascending")])
        _, first = np.unique(table["row"].to_numpy(), return_index=True)
        return table.take(pa.array(np.sort(first)[:GIVEN]))

    def local(batches):
        kept: dict[tuple[int, int], pa.Table] = {}
        for b in batches:
            odds = slim.views(np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(b.num_rows, -1), _meta(b))
            rows = b.column("row").to_numpy()
            for view in (0, 1):
                had = np.array([r for v, r in taken if v == view], np.int64)
                for label in (0, 1):
                    sign = 1 if label else -1
                    p = sigmoid(sign * odds[view])
                    at = np.flatnonzero((sign * (odds[view] - slim.base) >= MARGIN) & ~np.isin(rows, had))
                    n = len(at)
                    more = [pa.array(np.full(n, view, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(p[at]), pa.array((rows[at] % PARTS).astype(np.int32))]
                    new = pa.table([*more, *(b.column(c).take(pa.array(at)) for c in _NAMES)], names=["view", "label", "sure", "part", *_NAMES])
                    kept[view, label] = best(pa.concat_tables([kept[view, label], new]) if (view, label) in kept else new)
        for t in kept.values():
            yield from t.combine_chunks().to_batches()

    near = pool.mapInArrow(local, kind)
    near = near.groupBy("view", "label", "part").applyInArrow(best, kind)
    return near.groupBy("view", "label").applyInArrow(best, kind).collect()


def train(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """Fitted on a bounded sample of labelled rows and on all unlabelled ones; None if a class has too few labels."""
    ids, counts = sample_ids(labels, "quality", SAMPLE)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    known = _features(labelled(docs, ids)).collect()
    known.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r.doc_id)), r.row))
    y = np.array([r.y for r in known], float)
    if min((y == 0).sum(), (y == 1).sum()) < FOLDS + 1:
        return None
    shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    stacked = lambda rows: np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    model = CoTrained(stacked(known), [(r.lang, r.source, r.n_chars) for r in known], y, shift)
    named = labels.where("doc_id is not null and quality is not null").select("doc_id").distinct()
    pool = written(_features(docs).join(named, "doc_id", "left_anti").select(*_NAMES), "pool")
    taken: set[tuple[int, int]] = set()
    for _ in range(ROUNDS):
        got = sorted(_surest(pool, model, taken), key=lambda r: (r.view, r.label, -r.sure, r.row))
        if not got:
            break
        for view in (0, 1):
            for label in (0, 1):
                if rows := [r for r in got if (r.view, r.label) == (view, label)]:
                    p = np.clip([r.sure if label else 1 - r.sure for r in rows], 1e-6, 1 - 1e-6)
                    model.learn(view, p, stacked(rows), [(r.lang, r.source, r.n_chars) for r in rows])
                    taken.update((view, r.row) for r in rows)
        model.refit()
    return model


def _scored(docs: DataFrame, model: CoTrained | None) -> tuple[DataFrame, list[str]]:
    """``docs`` with four more columns, whose names come with it: score, those of the views, and whether to keep."""
    names = fresh(docs.columns, "score", "p_text", "p_meta", "keep")
    slim = model.trimmed() if model else None

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                x = b.slice(at, 1000)
                texts = x.column("text").to_pylist()
                p = slim.predict(text_views(texts), _meta(x)) if slim else np.ones((x.num_rows, 3))
                some = np.array([bool(t and not t.isspace()) for t in texts], bool)
                p[~some] = 0
                columns = [*(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays([*x.columns, *columns], [*x.schema.names, *names])

    more = [T.StructField(n, T.BooleanType() if n == names[-1] else T.DoubleType()) for n in names]
    return bounded(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *more])), names


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, score, p_text, p_meta, keep`` (score of one half or more).

    Null, empty and blank texts score zero. If either class has no more labelled documents than there are
    folds, no model can be fitted, and all other texts score one. Null metadata is a value of its own.
    Repeated rows and null ids come out as they came in; further columns are not carried. Nothing is
    shuffled to score.
    """
    rows, _ = _scored(docs.select("doc_id", "text", "lang", "source", "n_chars"), train(docs, labels))
    return rows.select("doc_id", "score", "p_text", "p_meta", "keep")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps; columns as they came."""
    rows, names = _scored(docs, train(docs, labels))
    return rows.where(F.col(names[-1])).select(*docs.columns)
