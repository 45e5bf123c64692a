"""Toxicity by a chain of linear classifiers.

Categories are predicted in turn; the models of later ones also see the probabilities of earlier ones.
They are trained on out-of-fold probabilities, so that a later model meets at training what it will
meet at scoring. The chain has a link for each thing that the labels tell: poor quality, then toxicity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded, ddl, words
from llm.labelled import labelled, sample_ids
from llm.linear import Rows, fit_sparse, folds, sigmoid

CATEGORIES = ("poor", "toxic")  # in the order of the chain
SAMPLE = 3000  # labelled rows of each class that train the chain, at most
FOLDS = 3
BITS = 18  # words and their beginnings are hashed into 2**BITS features
MASK = (1 << BITS) - 1
PREFIXES = (4, 5, 6, 7, 8)  # bytes
OFTEN = 3  # distinct words of a document from which one beginning counts as frequent

_places: dict[bytes, list[int]] = {}


def features(text: str | None) -> np.ndarray:
    """Places of a text's distinct words, of their beginnings, and of frequent beginnings; blank texts have none."""
    global _places
    if len(_places) > 150_000:
        _places = {}
    known, found = _places, []
    for w in set(words(text)):
        if (places := known.get(w)) is None:
            parts = [w, *(b"^" + w[:k] for k in PREFIXES if len(w) >= k)]
            places = known[w] = [xxhash.xxh32_intdigest(p) & MASK for p in parts]
        found.extend(places)
    place, n = np.unique(np.array(found, np.int64), return_counts=True)
    return np.unique(np.concatenate([place, (place[n >= OFTEN] * 31 + 7) & MASK]))


class Chain:
    """Models of all categories in turn: weights of words, of earlier categories' log odds, and an intercept.

    A target may be NaN where it isn't known; such rows don't train its link, but get its prediction. A category
    of which nothing or only one class is known has a link that says nothing.
    """

    def __init__(self, x: Rows, targets: list[np.ndarray], shift: float = 0.0):
        fold = folds(x.n, FOLDS)
        earlier = np.zeros((x.n, 0))
        self.models = []
        for y in targets:
            unseen, known = np.zeros(x.n), ~np.isnan(y)
            for k in range(FOLDS):
                rest, own = np.flatnonzero((fold != k) & known), np.flatnonzero(fold == k)
                if len(own):
                    unseen[own] = self._logit(x.take(own), earlier[own], self._fit(x, earlier, y, rest))
            self.models.append(self._fit(x, earlier, y, np.flatnonzero(known)))
            earlier = np.c_[earlier, np.clip(unseen, -6, 6)]
        self.out_of_fold, self.shift = sigmoid(earlier), shift

    @staticmethod
    def _fit(x: Rows, earlier: np.ndarray, y: np.ndarray, rows: np.ndarray):
        if not len(rows) or y[rows].min() == y[rows].max():
            return np.zeros(x.width), np.zeros(earlier.shape[1]), 0.0
        return fit_sparse(x.take(rows), earlier[rows], y[rows])

    @staticmethod
    def _logit(x: Rows, earlier: np.ndarray, model) -> np.ndarray:
        w, v, b = model
        return x.dot(w) + earlier @ v + b

    def predict(self, x: Rows) -> np.ndarray:
        """Probabilities, a column for each category; ``shift`` corrects the last for the sample's balance."""
        z = np.zeros((x.n, 0))
        for model in self.models:
            z = np.c_[z, np.clip(self._logit(x, z, model), -6, 6)] if model is not self.models[-1] else np.c_[z, self._logit(x, z, model) + self.shift]
        return sigmoid(z)


def train(docs: DataFrame, labels: DataFrame) -> Chain | None:
    """A chain fitted on at most SAMPLE labelled rows of each class; None if a class has no row."""
    ids, counts = sample_ids(labels, "toxic", SAMPLE, "quality")
    rows = labelled(docs.select("doc_id", "text"), ids).select("doc_id", "y", F.col("quality").cast("double").alias("quality"), "text")

    def run(batches):
        for b in batches:
            places = [features(t).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]  # packed, as they go to the driver
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "y", "quality")), pa.array(places, pa.binary())], ["doc_id", "y", "quality", "at"])

    got = rows.mapInArrow(run, f"doc_id {ddl(docs, 'doc_id')}, y int, quality double, at binary").collect()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r.doc_id)), r.doc_id))
    y = np.array([r.y for r in got], float)
    if not len(y) or y.min() == y.max():
        return None
    x = Rows([np.frombuffer(r["at"], np.int32) for r in got], 1 << BITS)
    poor = np.array([np.nan if r.quality is None else float(r.quality <= 0) for r in got])
    shift = np.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))) - np.log(y.sum() / (len(y) - y.sum()))
    return Chain(x, [poor, y], float(shift))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, p_poor, p_toxic, toxic`` (over one half).

    Null and blank texts have no words: probabilities of the intercepts, never toxic. Without labels of
    both classes all probabilities are zero. Repeated rows and null ids come out as they came in;
    further columns are not carried. Each task scores its own documents; nothing is shuffled.
    """
    chain = train(docs, labels)
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches):
        for b in batches:
            x = Rows([features(t) for t in b.column("text").to_pylist()], 1 << BITS)
            p = chain.predict(x) if chain else np.zeros((x.n, len(names)))
            toxic = (p[:, -1] > 0.5) & (x.length > 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(toxic)], ["doc_id", *names, "toxic"])

    kind = f"doc_id {ddl(docs, 'doc_id')}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"
    return bounded(docs.select("doc_id", "text")).mapInArrow(run, kind)
