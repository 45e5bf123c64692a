import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import quality, toxicity
from llm.linear import Dense, Rows, fit_sparse, sigmoid

SF = "/root/testdata/sf0.1"


def split(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0
    return docs, labels.where(~test), labels.where(test)


def test_toxicity_held_out(spark):
    docs, train, test = split(spark)
    out = toxicity.scored(docs, train).join(test, "doc_id")
    rows = out.select("p_toxic", (F.col("p_toxic") > 0.5).alias("said"), test["toxic"].alias("is")).collect()
    hit = sum(r.said and r["is"] for r in rows)
    assert hit >= 0.85 * sum(r["is"] for r in rows) and hit >= 0.95 * sum(r.said for r in rows)


def test_quality_held_out(spark):
    docs, train, test = split(spark)
    rows = quality.scored(docs, train).join(test, "doc_id").select("keep", "quality").collect()
    bad = [r for r in rows if not r.quality]
    assert sum(not r.keep for r in bad) >= 0.9 * len(bad)
    good = [r for r in rows if r.quality]
    assert sum(r.keep for r in good) >= 0.98 * len(good)


def test_edges(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, at double, y int"  # names that training uses, too
    rows = [(1, None, None, None, None, None, 1), (2, "", "en", "s", 0, 0.0, 0), (3, " \n", "en", "s", 2, 0.0, 0), (None, "word " * 50_000, "en", None, -1, 0.0, 0), (2, "", "en", "s", 0, 0.0, 0)]
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.keep for r in quality.scored(docs, labels).orderBy("doc_id").collect()] == [True, False, False, False, False]
    assert quality.kept(docs, labels).columns == docs.columns
    assert toxicity.scored(docs, labels).count() == 5
    none = docs.limit(0)
    assert quality.scored(none, labels.limit(0)).collect() == [] and toxicity.scored(none, labels.limit(0)).collect() == []
    assert [r.toxic for r in toxicity.scored(docs, labels.limit(0)).collect()] == [False] * 5


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    x = Rows([np.flatnonzero(rng.random(30) < 0.3) for _ in range(300)], 30)
    noise = (rng.random(300) < 0.5).astype(float)  # can't be predicted out of fold
    chain = toxicity.Chain(x, [noise, noise])
    assert abs(np.corrcoef(chain.out_of_fold[:, 0], noise)[0, 1]) < 0.25
    assert chain.predict(x).shape == (300, 2)


def test_unknown_targets_train_nothing():
    rng = np.random.default_rng(2)
    x = Rows([np.flatnonzero(rng.random(30) < 0.3) for _ in range(600)], 30)
    has = np.array([0 in x.take(np.array([i])).at for i in range(600)], float)
    part = np.where(rng.random(600) < 0.5, has, np.nan)
    chain = toxicity.Chain(x, [part, has])
    assert ((chain.predict(x) > 0.5) == has[:, None].astype(bool)).mean() > 0.97
    none = toxicity.Chain(x, [np.full(600, np.nan), has])
    assert (none.predict(x)[:, 0] == 0.5).all() and ((none.predict(x)[:, 1] > 0.5) == has).mean() > 0.97


def test_models_separate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] - x[:, 1] > 0.3).astype(float)
    assert ((Dense(x, y).logits(x) > 0) == y).mean() > 0.97
    rows = Rows([np.flatnonzero(r > 0.5) for r in x], 3)
    w, v, b = fit_sparse(rows, np.zeros((500, 0)), (x[:, 2] > 0.5).astype(float))
    assert ((sigmoid(rows.dot(w) + b) > 0.5) == (x[:, 2] > 0.5)).all() and w[2] == pytest.approx(max(w))


def test_views_teach_each_other(spark):
    """Texts that tell nothing where the metadata does, and the other way round: labels go both ways."""
    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for i in range(1500):
        good = bool(rng.random() < 0.5)
        plain, named = rng.random() < 0.7, rng.random() < 0.7
        marks = rng.normal(0.2 if good else 0.8, 0.05) if plain else rng.normal(0.5, 0.05)
        text = " ".join("a#" if rng.random() < marks else "bcd" for _ in range(60))
        rows.append((i, text, "en", f"{'good' if good else 'bad'}{rng.integers(0, 3)}" if named else f"any{rng.integers(0, 3)}", len(text), 0.5, True))
        truth[i] = good
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, keep boolean")
    labels = spark.createDataFrame([(i, int(truth[i])) for i in range(0, 1500, 3)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert min(model.given) > 0
    unseen = [r for r in quality.scored(docs, labels).collect() if r.doc_id % 3]
    right = [np.mean([(p >= 0.5) == truth[r.doc_id] for r, p in zip(unseen, column)]) for column in zip(*((r.score, r.p_text, r.p_meta) for r in unseen))]
    assert right[0] > max(right[1:]) and min(right[1:]) < 0.92
    assert quality.kept(docs, labels).columns == docs.columns


def test_harmful_labels_are_taken_back():
    rng = np.random.default_rng(8)
    y = (rng.random(400) < 0.5).astype(float)
    x = np.c_[y + rng.normal(size=400) * 0.3, rng.normal(size=400)].astype(np.float32)
    model = quality.CoTrained(x, [("en", "a" if v else "b", 5) for v in y], y)
    before = list(model.accuracy)
    model.learn(1, np.full(400, 0.99), np.c_[np.zeros(400), np.zeros(400)].astype(np.float32), [("en", "b", 5)] * 400)
    model.refit()
    assert (model.given, model.refused, model.accuracy) == ([0, 0], [0, 400], before)
    good = np.c_[np.ones(50), rng.normal(size=50)].astype(np.float32)
    model.learn(1, np.full(50, 0.95), good, [("en", "a", 5)] * 50)
    model.refit()
    assert model.given == [0, 50] and model.refused == [0, 400]


def test_surest_of_all_rows(spark, monkeypatch):
    """The selection over tasks and groups gives what sorting all rows gives."""
    monkeypatch.setattr(quality, "MARGIN", 0.4)

    class Model:
        base = 0.1

        def trimmed(self):
            return self

        def views(self, x, meta):
            return np.stack([x[:, 0].astype(float), -x[:, 0].astype(float)])

    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 2000)), np.float32(round(rng.normal(), 1)), None) for _ in range(3000)]
    odds = {row: x for row, x, _ in reversed(rows)}
    pool = spark.createDataFrame([(r, odds[r].tobytes(), "en", None, None) for r, _, _ in rows], quality._ROW).repartition(7)
    taken = {(0, r) for r in list(odds)[:300]}
    got = {(v, y): [] for v in (0, 1) for y in (0, 1)}
    for r in quality._surest(pool, Model(), taken):
        got[r.view, r.label].append((-r.sure, r.row))
    for (view, label), some in got.items():
        z = {r: x * (1 if label else -1) * (1 if view == 0 else -1) for r, x in odds.items() if (view, r) not in taken}
        base = 0.1 if label else -0.1
        want = sorted((-float(sigmoid(float(x))), r) for r, x in z.items() if float(x) - base >= 0.4)[: quality.GIVEN]
        assert sorted(r for _, r in some) == sorted(r for _, r in want)


def plain_toxicity_features(text):
    """Distinct words, their beginnings, and beginnings that several distinct words share, without hashing tricks."""
    found = {}
    for w in set(toxicity.words(text)):
        for part in [w, *(b"^" + w[:k] for k in (4, 5, 6, 7, 8) if len(w) >= k)]:
            place = toxicity.xxhash.xxh32_intdigest(part) % 2**18
            found[place] = found.get(place, 0) + 1
    return set(found) | {(p * 31 + 7) % 2**18 for p, n in found.items() if n >= 3}


def test_scores_match_plain_scoring(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    chain = toxicity.train(docs, labels)
    one = lambda z: 1 / (1 + np.exp(-z))
    for r in toxicity.scored(docs, labels).collect():
        own, z = sorted(plain_toxicity_features(rows[r.doc_id].text)), []
        for k, (w, v, b) in enumerate(chain.models):
            score = sum(w[i] for i in own) + sum(x * y for x, y in zip(v, z)) + b
            z.append(min(6, max(-6, score)) if k < 1 else score + chain.shift)
        assert [r.p_poor, r.p_toxic] == pytest.approx([one(x) for x in z], abs=1e-9)
    model = quality.train(docs, labels)
    for r in quality.scored(docs, labels).collect():
        x = rows[r.doc_id]
        if not (x.text or "").strip():
            assert r.score == r.p_text == r.p_meta == 0 and not r.keep
            continue
        raw, z = x.text.encode(), []
        share = [np.log1p(1000 * raw.count(bytes([c])) / len(raw)) for c in range(128)]
        assert quality.text_view(x.text)[:128] == pytest.approx(share, rel=1e-6)
        meta = [float(repr(v) == name) for column, v in zip(model.encode.columns, (x.lang, x.source)) for name in column] + [np.log1p(x.n_chars), np.log1p(x.n_chars) ** 2 / 10, 0]
        for m, scale, view in zip(model.models, model.scales, (quality.text_view(x.text), meta)):
            raw_odds = sum(w * (a - mean) / s for w, a, mean, s in zip(m.w, view, m.mean, m.scale)) + m.w[-1]
            z.append(min(12, max(-12, scale.w[0] * (raw_odds - scale.mean[0]) / scale.scale[0] + scale.w[1])))
        mixed = sum(w * (a - mean) / s for w, a, mean, s in zip(model.mix.w, z, model.mix.mean, model.mix.scale)) + model.mix.w[-1]
        assert [r.score, r.p_text, r.p_meta] == pytest.approx([one(v + model.shift) for v in (mixed, *z)], abs=1e-6)
