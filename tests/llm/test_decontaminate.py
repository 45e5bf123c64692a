import hashlib
import random
import re

import numpy as np

from llm import decontaminate as d


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items, window=10):
    own, hit, names = plain_words(text), set(), set()
    for item, phrase in items:
        w = plain_words(phrase)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for k in range(len(own) - len(p) + 1):
                if own[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    names.add(str(item))
    return len(own), len(hit), sorted(names)


def test_index_counts_and_places():
    rnd = np.random.default_rng(3)
    for n, top in ((1, 1), (50, 2), (3000, 4), (5000, 40)):
        text = rnd.integers(0, top + 1, n)
        text[n // 2 :] = text[: n - n // 2] if rnd.random() < 0.7 else text[n // 2 :]
        index = d.FMIndex(text, top)
        for _ in range(30):
            m = rnd.integers(1, 6)
            p = rnd.integers(1, top + 1, m)
            lo, hi = index.search(np.r_[np.zeros(6 - m, np.int64), p][None])
            expect = [i for i in range(n - m + 1) if (text[i : i + m] == p).all()]
            assert sorted(index.locate(np.arange(lo[0], max(lo[0], hi[0])))) == expect


def test_report_and_removal(spark, monkeypatch):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(12)] + ["Über", "naïve", "日本"]
    phrase = lambda n: " ".join(rnd.choices(vocab, k=n))
    items = [(i, phrase(rnd.choice([2, 5, 10, 11, 25]))) for i in range(30)] + [(98, None), (99, " ,; "), (5, "Repeat Id"), (None, "w1")]
    docs = []
    for i in range(120):
        parts = [phrase(rnd.randint(0, 40)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, rnd.choice(items[:30])[1].replace(" ", rnd.choice([", ", "\n", " - "])).upper().replace("Ü", "ü").replace("Ï", "ï"))
        docs.append((i, " ".join(parts), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, "repeat id", "x"), (3, docs[3][1], "x")]
    monkeypatch.setattr(d, "SHARD_WORDS", 700)
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    for size in (500_000, 60):
        monkeypatch.setattr(d, "PASS_WINDOWS", size)
        got = {r.doc_id: r for r in d.report(df, bench).collect()}
        assert len(got) == len(docs) - 1
        for i, text, _ in docs:
            n, hit, names = plain(text, known)
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
            assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    left = {r.doc_id: r for r in d.removed(df, bench).collect()}
    assert 502 not in left and 500 in left
    for i, text, _ in docs:
        n, hit, _ = plain(text, known)
        assert (i in left) == (not hit or hit < n)
        if i in left:
            assert len(plain_words(left[i].text)) == n - hit if hit else left[i].text == text


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.report(docs, none).first().n_hit == 0
    assert d.report(docs.limit(0), none).collect() == []


def test_clashing_names_and_repeated_rows(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    rows = [(7, "x a b c d e f g h i j y", 77, 5, "s"), (7, "x a b c d e f g h i j y", 77, 5, "s"), (7, "other words", 78, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, n_chars long, spans string")
    got = sorted(d.removed(docs, bench).collect(), key=lambda r: r.n_words)
    assert [(r.doc_id, r.text.split(), r.n_words, r.n_chars, r.spans) for r in got] == [(7, ["x", "y"], 77, len(got[0].text), "s")] * 2 + [(7, ["other", "words"], 78, None, None)]
    assert sorted((r.n_words, r.n_hit) for r in d.report(docs, bench).collect()) == [(2, 0), (12, 10), (12, 10)]
