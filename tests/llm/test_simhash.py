import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from llm import simhash
from llm.components import connected_components


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def plain_shingles(text, words):
    parts = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []


def plain_fingerprint(text, words=3):
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in plain_shingles(text, words)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain_similarity(a, b):
    a, b = (set(plain_shingles(t, 5)) for t in (a, b))
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_groups(rows):
    """The least id of each id's group; ``rows`` are ids and texts."""
    texts = sorted({t or "" for _, t in rows})
    fps = {t: plain_fingerprint(t, 2) for t in texts}
    near = [(a, b) for a in texts for b in texts if a < b and (fps[a] ^ fps[b]).bit_count() <= simhash.WIDE and plain_similarity(a, b) >= 0.8]
    group, least = roots(texts, near), {}
    for i, t in rows:
        least[group[t or ""]] = min(i, least.get(group[t or ""], i))
    return {i: least[group[t or ""]] for i, t in rows}


def edited(rnd, n, vocab, share=0.7):
    rows = []
    for i in range(n):
        base = rows[rnd.randrange(len(rows))][1].split() if rows and rnd.random() < share else rnd.choices(vocab, k=rnd.randint(1, 300))
        if base and rnd.random() < 0.8:
            base[rnd.randrange(len(base))] = rnd.choice(vocab)
        rows.append((i, " ".join(base)))
    return rows


def check(spark, rows, **more):
    out = {}
    for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, fp string"), **more).collect():
        out.setdefault(r.doc_id, (r.fp % 2**64, r.component_id))
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    ids = sorted(fps)
    expect = roots(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert out == {i: (fps[i], expect[i]) for i in ids}


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"Wört{i}" for i in range(50)]
    rows = [(*r, "x") for r in edited(rnd, 150, vocab)]
    rows += [(200, None, "x"), (201, "", "x"), (202, " \t\n", "x"), (203, "one", "x"), (203, "one", "x"), (204, "long " * 40_000, "x")]
    check(spark, rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_hot_keys_in_blocks(spark):
    rnd = random.Random(1)
    fps = list({rnd.getrandbits(20) << 3 | 7 for _ in range(400)} | {rnd.getrandbits(64) for _ in range(100)})
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for tau in (3, 7):
        got = connected_components(simhash.near_links(table, tau, block=32)).collect()
        expect = roots(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= tau])
        assert expect == {i: i for i in expect} | {r.node: r.root for r in got}


def test_every_allocation_finds_all(spark):
    assert simhash.allocate([[0, 1, 9], [0, 5, 9], [0, 5, 6]], 1)[1] in ([1, 0, 0], [0, 0, 1])
    groups = simhash.correlated_partitions(np.random.default_rng(0).integers(0, 2, (50, 64)).astype(float), 3)
    assert sorted(sum(groups, [])) == list(range(64)) and {len(g) for g in groups} <= {21, 22}


def test_keep_first(spark):
    rows = [(1, "a b c d", "en", "n1"), (2, "a b c d", "en", "n2"), (2, "a b c d", "en", "n2"), (3, "q r s t u v w", "de", None)]
    out = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string, node string"))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3] and out.columns == ["doc_id", "text", "component_id", "node"]


def test_keep_first_matches_brute_force(spark):
    rnd = random.Random(8)
    rows = edited(rnd, 200, [f"Wört{i}" for i in range(400)]) + [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "two"), (305, "one")]
    rows += [(306, "so few words"), (307, "So  few words"), (308, "long " * 40_000), (309, "long " * 40_000 + "end")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    groups = plain_groups(rows)
    assert sorted(r.doc_id for r in kept) == sorted(set(groups.values()))
    assert 20 < len(set(groups.values())) < len({t for _, t in rows})


def test_keep_first_of_an_empty_table(spark):
    assert simhash.keep_first(spark.createDataFrame([], "doc_id bigint, text string, root string")).collect() == []


def test_one_large_group_in_blocks(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(200)]
    texts = [(i, " ".join(base[:at] + [f"x{i}"] + base[at:])) for i, at in enumerate(rnd.choices(range(200), k=150))]
    texts += [(200 + i, " ".join(f"y{rnd.randrange(500)}" for _ in range(200))) for i in range(5)]
    docs = spark.createDataFrame(texts, "node bigint, text string")
    nodes = spark.createDataFrame([(i, plain_fingerprint(t, 2) - 2**63) for i, t in texts], "node bigint, fp bigint")
    got = connected_components(simhash.similar_links(docs, nodes, tau=20, block=16)).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(150)}


def test_recall_of_candidates():
    """Edited copies of a similarity just above the threshold lie within the candidates' bits."""
    rnd, near, found = random.Random(4), 0, 0
    for _ in range(300):
        base = [f"w{rnd.randrange(800)}" for _ in range(rnd.randint(60, 400))]
        copy = list(base)
        for at in rnd.sample(range(len(base)), len(base) // 60):
            copy[at] = "changed"
        a, b = " ".join(base), " ".join(copy)
        if plain_similarity(a, b) >= 0.8:
            near += 1
            found += (plain_fingerprint(a, 2) ^ plain_fingerprint(b, 2)).bit_count() <= simhash.WIDE
    assert near > 100 and found >= 0.9 * near


def test_components_of_a_path(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {(r.node, r.root) for r in connected_components(edges).collect()} == {(i, 0) for i in range(60)}


def test_null_ids_link_and_stay(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "e f g h i"), (None, "q r s t u"), (4, "q r s t u"), (7, "one text"), (7, "another text")], "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_first(docs).collect()), key=str)
    assert kept == sorted([(None, "a b c d"), (None, "e f g h i"), (4, "q r s t u"), (7, "one text"), (7, "another text")], key=str)
    one = spark.createDataFrame([(None, "q r s t u"), (4, "q r s t u")], "doc_id bigint, text string")
    assert [r.doc_id for r in simhash.keep_first(one).collect()] == [4]


def test_null_ids_connect_others(spark, monkeypatch):
    fps = [(5, 0), (9, 63), (None, 7)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: spark.createDataFrame(fps, "doc_id bigint, fp bigint"))
    got = simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (9, 5), (None, 5)}


def test_keep_first_of_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c d", x, {"k": x}) for x in ("p", "q", "r", "q", "r")] + [(2, "a b c d", "p", {"k": "p"})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, one string, more map<string,string>")
    got = [r.one for r in simhash.keep_first(docs).collect()]
    assert len(got) == 1 and got == [r.one for r in simhash.keep_first(docs.repartition(3)).collect()]


def test_a_group_of_many_blocks_ships_only_sets_in_doubt(spark, monkeypatch):
    """Copies mostly connect in two dealings, so of all pairs of blocks only what is in doubt is compared by sets."""
    rnd, rows = random.Random(7), []
    for k in range(3):
        base = [f"w{k}x{rnd.randrange(500)}" for _ in range(200)]
        for _ in range(50):
            at = rnd.randrange(200)
            rows.append((len(rows), " ".join(base[:at] + [f"x{len(rows)}"] + base[at:])))
    rows += [(200 + i, " ".join(f"w0x{rnd.randrange(500)}" for _ in range(200))) for i in range(20)]
    seen, compared = [], simhash._compared
    monkeypatch.setattr(simhash, "_compared", lambda dealt, *a: seen.append(dealt.count()) or compared(dealt, *a))
    docs = spark.createDataFrame(rows, "node bigint, text string")
    nodes = spark.createDataFrame([(i, plain_fingerprint(t, 2) - 2**63) for i, t in rows], "node bigint, fp bigint")
    got = connected_components(simhash.similar_links(docs, nodes, tau=40, block=8)).collect()
    assert {r.node: r.root for r in got} == {i: i // 50 * 50 for i in range(150)}
    assert len(seen) == 3 and sum(seen) < 3 * len(rows)  # all pairs of 22 blocks ship each set 22 times


def test_a_key_is_compared_in_tiles():
    rnd = np.random.default_rng(2)
    fp = rnd.integers(0, 2**12, 300).astype(np.int64)
    own = rnd.random(300) < 0.6
    first = rnd.random(300) < 0.5
    for mask in (None, first):
        a, b = simhash._pairs(own, fp, mask, 2)
        want = [(fp[i], fp[j]) for i in range(300) for j in range(i) if (own[i] or own[j]) and fp[i] != fp[j] and (mask is None or mask[i] != mask[j]) and int(fp[i] ^ fp[j]).bit_count() <= 2]
        nodes = {x for e in want for x in e}
        assert roots(nodes, want) == roots(nodes, list(zip(a.tolist(), b.tolist())))


def test_only_one_of_two_keys_is_probed(spark):
    fps = spark.createDataFrame([(0,), (1,), (6,)], "fp bigint")
    rows = simhash._keys(fps, [([0, 1, 2], 2)]).collect()
    assert sorted((r.key, r.own, r.fp) for r in rows) == sorted([(f, True, f) for f in (0, 1, 6)] + [(0, False, 1)] + [(k, False, 6) for k in (4, 2, 5, 3, 0)])
